"""Personal data: regular expressions propose spans, checksums confirm them, context words adjust the score.

Four base kinds (email, ip, card, phone) are found leftmost and without overlap, each kind by itself; a proposal
that fails its check is dropped and the search goes on behind it. The method adds account numbers (``iban``,
mod-97; the length that the country code fixes, else the longest run of whole groups that holds) and a score per span: a checksum or a full pattern gives the base, context words within
``CONTEXT_CHARS`` before the span raise it, words that tell of other numbers lower it. Scores rank spans; they
never remove a base span.

Proposals are looked for only where they can be: around each ``@``, and in runs of digits and the signs between
them. That gives the same matches as scanning the whole text with the plain patterns, in linear time.

Null texts count as empty; an empty text has no spans; a null id is returned as it is, repeated rows give repeated results. Of
spans that start at one place the kind listed first comes first. Texts of any length are read whole, one at a time. An empty table
gives an empty result; columns other than id and text are not read, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sequora.llm.store import small_batches

KINDS = ("email", "ip", "card", "phone", "iban")
CONTEXT_CHARS = 40
#: Words near a span that make it likelier, or less likely, to be what its pattern says.
CONTEXT = {
    "email": ("mail", "contact", "write", "reach", "address"),
    "ip": ("ip", "host", "server", "address", "login"),
    "card": ("card", "visa", "credit", "payment", "mastercard"),
    "phone": ("phone", "call", "tel", "mobile", "fax"),
    "iban": ("iban", "account", "bank", "transfer"),
}
AGAINST = ("version", "isbn", "order", "invoice", "release", "token")
BASE_SCORE = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.6, "iban": 0.9}

_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_REGION = re.compile(r"[0-9+][0-9+ ().-]*")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_GROUP_END = re.compile(r"(?<=[A-Z0-9])(?![A-Z0-9])")
#: Characters of an account number by its country code.
IBAN_CHARS = {
    c: n
    for n, codes in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK", 21: "CH HR LI LV",
        22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL", 24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST",
        26: "IS TR", 27: "BI DJ FR GR IT MC MR SM", 28: "AL AZ BY CY DO GT HN HU LB NI PL SV", 29: "BR EG PS QA UA",
        30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in codes.split()
}


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else sum(divmod(2 * d, 10))
    return total % 10 == 0


def mod97(code: str) -> bool:
    code = code.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in code[4:] + code[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            end = m.end()
        at = text.find("@", max(at + 1, end))


def _numbers(text: str) -> Iterator[tuple[str, int, int]]:
    """ip, card and phone. No match leaves a region: regions hold every character that a match may have."""
    for region in _REGION.finditer(text):
        lo, hi = region.span()
        if hi - lo < 7:
            continue
        for chain in _CHAIN.finditer(text, lo, hi):
            parts, at = chain.group().split("."), chain.start()
            for k in range(0, len(parts) - 3, 4):
                four = parts[k : k + 4]
                end = at + sum(map(len, four)) + 3
                if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0") or 0) <= 255 for x in four):
                    yield "ip", at, end
                at = end + 1
        for m in _CARD.finditer(text, lo, hi):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                yield "card", *m.span()
        at = text.find("+", lo, hi)
        while at >= 0:
            if m := _PHONE.match(text, at, hi):
                if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                    yield "phone", *m.span()
                at = m.end() - 1
            at = text.find("+", at + 1, hi)


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    """A proposal may have swallowed words behind the number, so it is tried at the ends of its groups too."""
    m = _IBAN.search(text)
    while m:
        start, whole = m.span()
        ends = [e for x in _GROUP_END.finditer(text, start, whole) if (e := x.start()) - start - text.count(" ", start, e) >= 12]
        if want := IBAN_CHARS.get(text[start : start + 2]):
            ends = [e for e in ends if e < whole and e - start - text.count(" ", start, e) == want]
            ends.insert(0 if whole - start - text.count(" ", start, whole) == want else len(ends), whole)
        else:
            ends.reverse()
        end = next((e for e in ends if mod97(text[start:e])), None)
        if end:
            yield start, end
        m = _IBAN.search(text, end or start + 1)


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """(kind, start, end, score) by start, then kind in the order of ``KINDS``; code points, end exclusive."""
    found = [("email", *x) for x in _emails(text)]
    found += _numbers(text)
    found += [("iban", *x) for x in _ibans(text)]
    found.sort(key=lambda x: (x[1], KINDS.index(x[0])))
    out = []
    for kind, start, end in found:
        near = text[max(0, start - CONTEXT_CHARS) : start].lower()
        score = BASE_SCORE[kind] + 0.2 * any(w in near for w in CONTEXT[kind]) - 0.3 * any(w in near for w in AGAINST)
        out.append((kind, start, end, round(min(1.0, max(0.0, score)), 2)))
    return out


def _detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = [[{"kind": k, "start": s, "end": e, "score": p} for k, s, e, p in find_spans(t)] for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, SPANS)], names=["id", "spans"])


SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def detect(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id and ``spans``, an array of (kind, start, end, score)."""
    kind = docs.schema[id_col].dataType.simpleString()
    rows = small_batches(docs).select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_detect, f"id {kind}, spans array<struct<kind:string,start:bigint,end:bigint,score:double>>").withColumnRenamed("id", id_col)


def digest(found: DataFrame) -> DataFrame:
    """Counts, the digest of the base spans, and all spans as text."""
    base = F.filter("spans", lambda s: s["kind"] != "iban")
    said = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of_kind = lambda kind: lambda s: s["kind"] == kind
    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{k}") for k in KINDS[:4]]
    return found.select("doc_id", *counts, F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"), F.aggregate("spans", F.lit(0.0), lambda a, s: F.greatest(a, s["score"])).alias("top_score"))
