"""Chat formatting, whitening and phrases against plain versions, and the edge cases of their docstrings."""

import collections
import gzip
import hashlib
import json
import random
import re
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sequora.llm import chat, licenses, phrases, warc, whitening

SF = "/root/testdata/sf0.001"


def against_sql(df, sql, **tables):
    con = duckdb.connect()
    for name, table in tables.items():
        held = table.toArrow()
        con.register(name, held)
    found = con.execute(sql)
    columns = [x[0] for x in found.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str) == sorted(found.fetchall(), key=str)


AWKWARD = [
    (1, 0, "user", "[INST] [\\INST] [\\\\INST] \\[INST] x</s"), (1, 1, "assistant", "</s>"), (1, 1, "assistant", "</s>"), (1, None, "system", None), (2, 3, None, None), (2, 5, "tool", "<<SYS>> [ROLE] a [TEXT] b [/TEXT]\n"),
    (2, 4, "to[TEXT]ol\n", " <s> "), (None, 0, "user", ""), (None, 1, "assistant", "é" * 5000 + "🙂"), (3, 0, "assistant", ""), (4, 0, "assistant", " a "), (4, 1, "assistant", "\n</s>\n"), (5, 0, "user", "<</SYS>> <\\/s> [[INST]] <<<SYS>>"), (6, 0, "", "x"),
]


@pytest.mark.parametrize("template", [chat.DEFAULT, chat.IM])
def test_chat_comes_back(spark, template):
    rows = spark.createDataFrame([(*r, "m", 1) for r in AWKWARD], "conv_id long, turn long, role string, text string, messages string, record int")
    turns = chat.canonical_turns(chat.rows_as_records(rows)).where("layout is not null")
    assert turns.count() == len(AWKWARD)
    table = chat.formatted(turns, template=template).cache()
    expected = collections.defaultdict(list)
    for c, t, role, text in sorted(AWKWARD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        expected[c].append((role or "", text or ""))
    got = {r.conv_id: r for r in chat.digest(table, template=template).collect()}
    assert got.keys() == expected.keys()
    for r in table.collect():
        said, learned = expected[r.conv_id], "".join(x for role, x in expected[r.conv_id] if role == "assistant")
        d = got[r.conv_id]
        assert d.n_turns == len(said) and d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in said).encode()).hexdigest()
        assert (d.loss_chars, d.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert d.formatted_chars == len(r.formatted)
        for s in r.loss:
            assert r.formatted[s.start : s.end].encode() == r.formatted.encode()[s.first_byte : s.end_byte]


def test_escapes_are_reversible(spark):
    r = random.Random(3)
    parts = [*chat.DEFAULT.controls(), "\\", "<", "[", "s>", "/s>", "INST]", " ", "a"]
    rows = spark.createDataFrame([("".join(r.choice(parts) for _ in range(r.randrange(12))),) for _ in range(3000)], "t string").withColumn("e", chat.DEFAULT.escape(F.col("t")))
    found = rows.select("t", "e", chat.DEFAULT.unescape(F.col("e")).alias("back")).collect()
    assert all(x.t == x.back for x in found)
    assert not any(c in x.e for x in found for c in chat.DEFAULT.controls())
    assert len({x.e for x in found}) == len({x.t for x in found})


def test_chat_queries_against_sql(spark):
    conversations = spark.createDataFrame(AWKWARD, "conv_id long, turn long, role string, text string")
    table = chat.format_conversations(conversations.unionByName(chat.probe(spark)))
    against_sql(chat.digest(table), chat.ORACLE, conversations=conversations)
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    against_sql(chat.digest(chat.formatted(chat.canonical_turns(chat.relaid(given)))).select("conv_id", "n_turns", "turns_sha256"), chat.LAYOUTS_ORACLE, conversations=given)
    assert chat.digest(chat.formatted(chat.canonical_turns(chat.rows_as_records(conversations.limit(0))))).count() == 0


def test_no_python_worker_in_chat(spark):
    given = spark.read.parquet(f"{SF}/conversations.parquet")
    plan = chat.digest(chat.formatted(chat.canonical_turns(chat.rows_as_records(given))))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|ExternalRDD", plan)


def test_layouts_by_fingerprint(spark):
    records = {
        1: {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None, "weight": 1}], "id": 7},
        2: {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}], "system": "s"},
        3: {"instruction": "do", "input": "", "output": "done"},
        4: {"instruction": "do", "input": "this", "output": None, "system": "s"},
        5: {"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]},
        6: {"data": {"user": {"text": "q"}, "assistant": {"text": "r"}, "more": {}}},
        7: {"prompt": "p", "completion": "c"},
        8: {"prompt": "p", "other": "c"},
        9: {"messages": []},
        10: [1, 2],
        11: {"question": "q", "answer": 3, "context": "c"},
    }
    rows = [(k, json.dumps(v)) for k, v in records.items()] + [(12, "no {json"), (13, None), (14, "")]
    turns = chat.canonical_turns(spark.createDataFrame(rows, "conv_id long, record string")).collect()
    said = collections.defaultdict(list)
    for r in sorted(turns, key=lambda r: (r.conv_id, r.part or 0)):
        said[r.conv_id].append((r.layout, r.role, r.text))
    assert [x[1:] for x in said[1]] == [("user", "a"), ("assistant", "")]
    assert [x[1:] for x in said[2]] == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert [x[1:] for x in said[3]] == [("user", "do"), ("assistant", "done")]
    assert [x[1:] for x in said[4]] == [("system", "s"), ("user", "do\n\nthis"), ("assistant", "")]
    assert [x[1:] for x in said[5]] == [("user", "ab")]
    assert [x[1:] for x in said[6]] == [("user", "q"), ("assistant", "r")]
    assert [x[1:] for x in said[7]] == [("user", "p"), ("assistant", "c")]
    assert [x[1:] for x in said[11]] == [("user", "c\n\nq"), ("assistant", "3")]
    for k in (8, 9, 10, 12, 13, 14):
        assert said[k] == [(None, None, None)]
    names = [f for x in chat.LAYOUTS for f in x.fingerprints()]
    assert len(names) == len(set(names))


def whitened_plainly(vectors):
    """(n, deviation of each row, covariance, explained) in exact fractions where it counts."""
    x = [[int(np.floor(64 * float(c))) + 1_000_000 for c in v] for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[i] for r in x) for i in range(d)]
    v = [[Fraction(sum((n * r[i] - s[i]) * (n * r[j] - s[j]) for r in x), n**3) for j in range(d)] for i in range(d)]
    return x, s, np.array(v, float), [sum((n * r[i] - s[i]) ** 2 for i in range(d)) for r in x]


@pytest.mark.parametrize("case", ["usual", "wide", "flat"])
def test_whitening_against_fractions(spark, case):
    r = np.random.default_rng(4)
    dims = 5
    base = r.normal(size=(157, dims)) @ r.normal(size=(dims, dims))
    if case == "wide":
        base = base * [1e4, 1.0, 100.0, 3.0, 1000.0] - 5e5
    if case == "flat":
        base[:, 3] = 2.0
    vectors = base.tolist()
    bad = [None, [1.0] * 4, [], [1.0, None, 1.0, 1.0, 1.0], [1.0, float("nan"), 1.0, 1.0, 1.0], [1.0, float("inf"), 1.0, 1.0, 1.0]]
    rows = spark.createDataFrame([(i, v, 1, "x") for i, v in enumerate(vectors)] + [(900 + i, v, 2, "y") for i, v in enumerate(bad)] + [(None, vectors[0], 3, "z")], "vec_id long, embedding array<double>, n int, component string").repartition(3)
    used = vectors + [vectors[0]]
    x, s, v, far = whitened_plainly(used)
    n = len(used)
    out = whitening.whiten(rows, 32).toPandas()
    values, basis = np.linalg.eigh(v)
    values, basis = values[::-1], basis[:, ::-1]
    assert len(out) == n * dims and set(out.n) == {n} and out.identity_error.nunique() == 1 and out.identity_error.max() <= 1e-6
    for k in range(dims):
        part = out[out.component == k + 1].set_index("vec_id")
        assert [None if np.isnan(d) else d for d in part.deviation.loc[range(len(vectors))]] == [d if d < 2**63 else None for d in far[:-1]]
        assert abs(part.explained.iloc[0] - values[k] / values.sum()) < 1e-12
        got = part.whitened.loc[range(len(vectors))].to_numpy(float)
        if case == "flat" and k == dims - 1:
            assert np.isnan(got).all()
            continue
        want = np.array([[float(Fraction(n * a - b, n)) for a, b in zip(row, s)] for row in x[:-1]]) @ basis[:, k] / np.sqrt(values[k])
        assert min(np.abs(got - want).max(), np.abs(got + want).max()) < 1e-6


def test_planes_give_exact_products():
    r = np.random.default_rng(1)
    for bits in (1, 7, 40, 63):
        y = r.integers(0, 2**bits, (131, 4), dtype=np.uint64)
        width, count = whitening.limbs(131, bits)
        found = whitening.scatter(y, bits, width, count)
        for i in range(4):
            for j in range(i, 4):
                assert sum(int(found[k, i, j]) << (k * width) for k in range(count)) == sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j]))


def test_whitening_without_vectors(spark):
    kind = "vec_id long, embedding array<float>"
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(spark.createDataFrame(rows, kind)).count() == 0
    one = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])], kind)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained) for r in one] == [(1, 1, 0, None, 0.0), (2, 1, 0, None, 0.0)]


def texts_of(seed):
    r = random.Random(seed)
    words = ["the", "The", "of", "a", "big", "red", "é", "<s>", "x-1", "it's"]
    line = " ".join(r.choice(words) for _ in range(60)) + ". " + "a big red a big red, of"
    out = []
    for i in range(120):
        t = "".join(r.choice(words) + r.choice([" ", " ", "  ", "\t", ". ", "\n", ", ", ""]) for _ in range(r.randrange(60)))
        out.append((t + line * r.randrange(3), r.choice(["en", "de", None, ""])))
    return out + [(None, "en"), ("", None), ("a", "fr"), ("word " * 5000, "en"), (".\n", "en")] * 2


@pytest.mark.parametrize("every", [1, 3, 16, 10**6])
def test_phrases_against_sql(spark, every):
    docs = spark.createDataFrame([(*x, 1, "k") for x in texts_of(7)], "text string, lang string, n int, phrase string").repartition(3)
    against_sql(phrases.collocations(docs, every=every), phrases.ORACLE, documents=docs)


def test_phrases_of_nothing(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(docs).count() == 0


def test_chunks_own_each_word_once():
    r = random.Random(2)
    text = " ".join(r.choice("abcdefgh") for _ in range(3000)).encode()
    data = phrases._PLAIN[np.frombuffer(text, np.uint8)]
    words = text.split()
    at = 0
    for _, a, b, owned in phrases.chunks(np.array([0, len(data)]), data, 8):
        inside = bytes(data[a:b]).split()
        assert inside == words[at : at + len(inside)] and len(inside) == min(owned + phrases.LONGEST - 1, len(words) - at)
        at += owned
    assert at == len(words)


def test_false_headers_raise():
    good = warc.record(7, "http://e", b"abc", None, False)
    assert warc.parse(gzip.compress(good))["payload_bytes"] == 3
    for old, new in ((b"Content-Length: 3", b"Content-Length: 999"), (warc.base32_sha1(b"abc").encode(), warc.base32_sha1(b"abd").encode()), (b"abc\r\n", b"abd\r\n"), (b"abc\r\n", b"ab\r\n")):
        assert old in good
        with pytest.raises(warc.Damaged):
            warc.parse(gzip.compress(good.replace(old, new)))
    again = warc.record(8, "http://e", b"abc", 7, True)
    assert warc.parse(gzip.compress(again))["payload_digest"] == warc.base32_sha1(b"abc")
    with pytest.raises(warc.Damaged):
        warc.parse(gzip.compress(again.replace(b"\r\n\r\n\r\n\r\n", b"\r\n\r\nabc\r\n\r\n")))


def found_plainly(items):
    """Rules against an identifier sequence, written apart: at each place the first rule whose identifiers follow in order, each at most MAX_GAP sentences behind the last."""
    used, out = set(), []
    for i in range(len(items)):
        if i in used:
            continue
        for licence, kind, wanted in licenses.RULES:
            places = [i] if items[i][1] == wanted[0] else []
            for want in wanted[1:] if places else ():
                options = [j for j in range(places[-1] + 1, len(items)) if j not in used and items[j][1] == want and items[j][0] <= items[places[-1]][0] + licenses.MAX_GAP + 1]
                if not options:
                    places = []
                    break
                places.append(options[0])
            if places:
                used |= set(places)
                out.append((licence, kind, items[places[0]][2], items[places[-1]][3]))
                break
    return out


def test_licence_rules_against_a_plain_matcher():
    r = random.Random(6)
    kinds = [*licenses.SENTENCES, "tag:MIT", "notice:GPL-2.0-only"]
    for _ in range(400):
        at, items = 0, []
        for n in range(r.randrange(1, 12)):
            at += r.choice([0, 1, 1, 2, 5])
            items.append((at, r.choice(kinds if r.random() < 0.4 else ["gpl-grant", "version-2", "version-2-later", "gnu-warranty", "mit-grant", "mit-condition", "as-is"]), n * 10, n * 10 + 5))
        assert [(m["licence"], m["rule"], m["start"], m["end"]) for m in licenses.match(items)] == found_plainly(items)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("SPDX-License-Identifier: GPL-2.0-only", ["GPL-2.0-only"]),
        ("/* SPDX-License-Identifier: GPL-2.0-or-later */", ["GPL-2.0-or-later"]),
        ("# SPDX-License-Identifier: MIT OR Apache-2.0", ["MIT", "Apache-2.0"]),
        ("SPDX-License-Identifier: (GPL-2.0+ WITH Classpath-exception-2.0) AND BSD-3-Clause\nMIT", ["GPL-2.0-or-later", "BSD-3-Clause"]),
        ("This is NOT, in any way, released under the MIT License.", []),
        ("It is not new, but it is released under the MIT License.", ["MIT"]),
        ("Licensed under GPLv3.", ["GPL-3.0"]),
        ("Released under LGPL v2.1 or later", ["LGPL-2.1-or-later"]),
        ("This program is distributed under the terms of the GNU General Public License version 2 only.", ["GPL-2.0-only"]),
        ("GNU GENERAL PUBLIC LICENSE\n Version 3, 29 June 2007\n\nCopyright", ["GPL-3.0"]),
        ("Apache License\nVersion 2.0, January 2004\nhttp://www.apache.org/licenses/", ["Apache-2.0"]),
        ("Mozilla Public License Version 2.0\n1. Definitions", ["MPL-2.0"]),
    ],
)
def test_licences_of_one_text(text, want):
    assert re.search(licenses._MARKED, text)
    assert [m["licence"] for m in licenses.match(licenses.identify(text))] == want


def test_deviations_beyond_64_bits_are_null():
    for x in ([[2**61, 5], [-(2**61), 7], [3, 9]], [[10**6, 5], [10**6 + 3, 7]]):
        n, s = len(x), [sum(r[i] for r in x) for i in range(2)]
        spread = max(abs(n * r[i] - s[i]) for r in x for i in range(2))
        want = [sum((n * r[i] - s[i]) ** 2 for i in range(2)) for r in x]
        assert whitening.deviations(np.array(x, np.int64), {"n": n, "sums": s, "spread": spread, "dims": 2}) == [d if d < 2**63 else None for d in want]
