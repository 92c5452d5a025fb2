"""Each operator against a plain brute-force version on small fixtures, and the edge cases that its docstring defines."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sequora.llm import bpe, decontaminate, exact_dedup, jaccard_join, licenses, pii, quality, shingles, suffix_dedup, toxicity, warc
from sequora.llm.components import components

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, maybe string, sha string, row string"


def docs_of(spark, texts):
    """Documents with extra columns whose names clash with working columns."""
    rows = [(i, t, "en", "s", len(t or ""), "m", "x", "y") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lam mu nu xi".split()


def prose(seed, n):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) + str(r.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def mixed():
    """Null, empty, short and long texts, copies, near copies, shared passages, repeated rows."""
    base, passage = prose(1, 60), prose(2, 30)
    near = base.split()
    near[30] = "changed"
    out = [(1, None), (2, ""), (3, "word"), (4, base), (5, base), (6, " ".join(near)), (7, base.upper()), (8, prose(3, 40) + " " + passage + " " + prose(4, 20)), (9, prose(5, 25) + " " + passage), (9, prose(6, 25)), (10, "   \n\t "), (11, "é" * 300), (12, "é" * 300 + " x"), (13, prose(7, 4000)), (14, prose(7, 4000) + " end"), (None, base), (15, "a b c"), (16, "A B C"), (17, passage), (17, passage)]
    return out + [(100 + i, " ".join(near[: 20 + i])) for i in range(30)]


def test_pii_spans_match_the_plain_patterns():
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

    def plain(t):
        out = [("email", *m.span()) for m in email.finditer(t)]
        out += [("ip", *m.span()) for m in ip.finditer(t) if all(int(x) <= 255 for x in m.group().split("."))]
        out += [("card", *m.span()) for m in card.finditer(t) if 12 <= len(d := re.sub("[^0-9]", "", m.group())) <= 19 and pii.luhn(d)]
        out += [("phone", *m.span()) for m in phone.finditer(t) if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15]
        return sorted(out, key=lambda x: (x[1], pii.KINDS.index(x[0])))

    r = random.Random(5)
    for _ in range(5000):
        t = "".join(r.choice("0123456789..+ -()@aé%") for _ in range(r.randrange(60)))
        assert [x[:3] for x in pii.find_spans(t) if x[0] != "iban"] == plain(t)


def test_pii_checks_and_context():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82 WEST 1234 5698 7654 32")
    plain = pii.find_spans("x 4111111111111111")[0]
    near, against = pii.find_spans("my card: 4111111111111111")[0], pii.find_spans("invoice 4111111111111111")[0]
    assert near[3] > plain[3] > against[3]
    assert [k for k, *_ in pii.find_spans("pay to IBAN GB82WEST12345698765432 now")] == ["iban"]
    assert pii.find_spans("1" * 200_000) == [] and pii.find_spans("") == []


def test_pii_ibans_before_other_words():
    for number, behind in (("ES91 2100 0418 4502 0005 1332", " BIC"), ("AT611904300234573201", " EUR 50"), ("BE68 5390 0754 7034", " KBC BRUSSELS"), ("PL61109010140000071219812874", " PLN"), ("DE89 3704 0044 0532 0130 00", " EUR"), ("ES91 2100 0418 4502 0005 1332", ".")):
        assert [x[:3] for x in pii.find_spans("to " + number + behind)] == [("iban", 3, 3 + len(number))], number
    two = "AT61 1904 3002 3457 3201 ES91 2100 0418 4502 0005 1332"
    assert [x[1:3] for x in pii.find_spans(two)] == [(0, 24), (25, 54)]
    assert [x[1:3] for x in pii.find_spans("REF1 AB12 ABCD EFGH " + two[25:])] == [(20, 49)]
    assert pii.find_spans("ES92 2100 0418 4502 0005 1332 BIC") == []


def test_pii_table(spark, mixed):
    got = pii.digest(pii.detect(docs_of(spark, mixed + [(50, "write a@b.co or +1 (555) 010-9999")]))).collect()
    assert len(got) == len(mixed) + 1
    row = next(r for r in got if r.doc_id == 50)
    assert (row.n_email, row.n_phone, row.spans) == (1, 1, "email:6:12,phone:16:33")
    assert next(r for r in got if r.doc_id == 1).base_sha256 == hashlib.sha256(b"").hexdigest()


def test_exact_duplicates(spark, mixed):
    got = exact_dedup.exact_duplicates(docs_of(spark, mixed)).collect()
    by = collections.defaultdict(list)
    for i, t in mixed:
        by[t or ""].append(i)
    assert len(got) == len(mixed)
    kept = collections.Counter()
    for r in got:
        group = next(g for t, g in by.items() if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.keep_id == max((x for x in group if x is not None), default=None) and r.group_size == len(group)
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1} and len(kept) == len(by)
    left = exact_dedup.drop_exact_duplicates(docs_of(spark, mixed))
    assert left.columns == [c.split()[0] for c in SCHEMA.split(", ")] and sorted(t or "" for (t,) in left.select("text").collect()) == sorted(by)


def shingle_set(text, width):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall("[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width, percent", [(4, 85), (5, 80)])
def test_jaccard_components(spark, mixed, width, percent):
    sets = [shingle_set(t, width) for _, t in mixed]
    parent = list(range(len(mixed)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    comp = collections.defaultdict(list)
    for i in range(len(mixed)):
        comp[find(i)].append(mixed[i][0])
    low = lambda ids: min(ids, key=lambda x: (x is not None, x or 0))
    want = collections.Counter((mixed[i][0], len(sets[i]), low(comp[find(i)])) for i in range(len(mixed)))
    got = jaccard_join.jaccard_components(docs_of(spark, mixed), width=width, percent=percent).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id) for r in got) == want
    assert sum(r.kept for r in got) == len(comp)
    assert jaccard_join.drop_near_duplicates(docs_of(spark, mixed), width=width, percent=percent).count() == len(comp)


def test_jaccard_histogram_bounds_the_overlap():
    r = np.random.default_rng(1)
    for n in (5, 60, 3000):
        a = np.unique(r.integers(0, 2**63, n, dtype=np.uint64))
        b = np.unique(np.r_[a[: n // 2], r.integers(0, 2**63, n // 3 + 1, dtype=np.uint64)])
        assert jaccard_join.overlap_bound(jaccard_join.histogram(a), jaccard_join.histogram(b)) >= len(np.intersect1d(a, b))


def _jobs(spark, group, run):
    """What ``run`` returns, and how many jobs it took."""
    spark.sparkContext.setJobGroup(group, group)
    try:
        return run(), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components_in_few_jobs(spark):
    """Chains, stars, pairs, links to oneself and links met twice; a round takes few jobs, as each costs the driver memory."""
    links = [(i, i + 1) for i in range(100, 130)] + [(500 - i, 501) for i in range(20)] + [(7, 3), (3, 7), (9, 9), (2**40, -5)]
    df = spark.createDataFrame(links, "a long, b long")
    got, n = _jobs(spark, "components", lambda: {r.node: r.label for r in components(df).collect()})
    want = {i: i for a, b in links if a != b for i in (a, b)}
    for _ in want:
        for a, b in links:
            if a != b:
                want[a] = want[b] = min(want[a], want[b])
    assert got == want
    assert n <= 48, n


def test_jaccard_cluster_without_a_centre(spark):
    """A chain of near copies, each close to the next only, is one component."""
    base = prose(9, 200).split()
    chain = [(i, " ".join(base[3 * i : 3 * i + 120])) for i in range(20)]
    got = jaccard_join.jaccard_components(docs_of(spark, chain), width=4, percent=85).collect()
    assert {r.component_id for r in got} == {0}


def test_decontaminate_drops_windows_where_they_are_made(spark):
    """Places, hashes and the look into the bitmap are one compiled step, for one width as for several: no lambda makes windows."""
    docs, bench = docs_of(spark, [(1, "alpha beta")]), spark.createDataFrame([(1, "one two three four five six seven eight nine")], "item_id long, text string")
    asked = decontaminate.cut(decontaminate._windows(decontaminate._sequences(bench, "item_id"), "item_id", [8], 8), "asked")
    for widths in ([8], [4, 5, 6, 7, 8]):
        rows = decontaminate._windows(decontaminate._sequences(docs, "doc_id"), "doc_id", widths, 8, decontaminate._bitmap(asked, asked.count()))
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            plan = rows._jdf.queryExecution().executedPlan().toString()
        finally:
            spark.conf.unset("spark.sql.adaptive.enabled")
        steps = [line for line in plan.splitlines() if "Generate" in line or "getbit" in line]
        assert any("getbit" in s for s in steps) and all("*(" in s.split("Generate")[0].split("Filter")[0] for s in steps), plan


def test_decontaminate_words_and_names(spark):
    """Signs go, a word of signs alone is none, a capital inside a sentence is a name; a text's own mark is none; only a sign at the very end of a word ends a sentence."""
    texts = ["The Cat saw. Bob (Ann) - Zoe, 12Kg\nFive ÉLAN Été", " Rome is", "a \x01Foo \x01 b\x01c", "end.\u2028 Foo end. Foo"]
    got = {r.doc_id: r.words for r in decontaminate.with_words(docs_of(spark, enumerate(texts))).collect()}
    want = ["the \x01cat saw bob \x01ann \x01zoe 12kg five élan \x01été", "\x01rome is", "a \x01foo bc", "end \x01foo end foo"]
    assert [got[k] for k in sorted(got)] == [w.split(" ") for w in want]


def test_decontaminate(spark):
    item = "On Monday the driver from Boston carried 12 boxes over 30 km and then came back with 7 boxes before noon"
    other = item.replace("12", "45").replace("30", "80").replace("7", "9").replace("Boston", "Denver")
    mixed_up = "On Monday the driver from Boston carried 12 boxes over 12 km and then came back with 12 boxes before noon"
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short"), (5, "five words stand just here")], "item_id long, text string")
    texts = [(1, "Before. " + item + " After."), (2, prose(1, 50) + "\n" + other + "\n" + prose(2, 50)), (3, prose(3, 80)), (4, None), (5, ""), (6, item.upper()), (7, "so five words stand just here now"), (8, mixed_up)]
    got = {(r.doc_id, r.item_id): r for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert set(got) >= {(1, 1), (2, 1), (7, 5)} and not {3, 4, 5, 8} & {d for d, _ in got}
    assert got[1, 1].verbatim and not got[2, 1].verbatim and got[1, 1].coverage > 0.8
    left = decontaminate.drop_contaminated(docs_of(spark, texts), bench)
    assert {3, 4, 5, 8} <= {r.doc_id for r in left.collect()} and not {1, 2, 7} & {r.doc_id for r in left.collect()}
    assert decontaminate.contaminated(docs_of(spark, texts), bench.limit(0)).count() == 0


def labelled(spark, name):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


@pytest.mark.parametrize("module, target, least", [(quality, "quality", 0.95), (toxicity, "toxic", 0.85)])
def test_classifiers_on_held_out_rows(spark, module, target, least):
    docs, labels = labelled(spark, target)
    got = module.scores(docs.unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")).withColumn("doc_id", F.lit(-1).cast("long"))), labels).collect()
    assert len(got) == 1001 and all(0 <= r.score <= 1 for r in got)
    y = {r.doc_id: r[target] for r in labels.collect()}
    held = [r for r in got if r.held_out and r.doc_id in y]
    assert sum(r.predicted == y[r.doc_id] for r in held) / len(held) >= least


def test_classifiers_without_labels(spark):
    docs = docs_of(spark, [(1, "a text"), (2, None)])
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.scores(docs, none).collect()} == {0.5}
    assert all(r.predicted == 0 for r in toxicity.scores(docs, none).collect())
    assert quality.keep_good(docs, none).count() == 2


def test_toxicity_kernel_is_an_inner_product_and_the_table_gives_it():
    words = [b"\0" + bytes(b - 96 for b in w) + b"\0" for w in (b"idiot", b"idxiot", b"word", b"ab")]
    f = [toxicity.features(w) for w in words]
    k = toxicity.kernel(f, f)
    assert np.allclose(k, k.T) and np.linalg.eigvalsh(k).min() > -1e-9
    brute = [[sum(v * b.get(key, 0) for key, v in a.items()) for b in f] for a in f]
    assert np.allclose(k, brute)
    assert k[0, 1] > k[0, 2]
    table = np.zeros(1 << 20, np.float32)
    for key, v in f[0].items():
        table[key] += v
    held = np.frombuffer(b"".join(w[:-1] for w in words) + b"\0", np.uint8)
    assert np.allclose(toxicity.decisions(toxicity.Known(table), held)[1], k[:, 0], atol=1e-5)


def test_toxicity_sees_through_inserted_signs():
    def of(text):
        _, held = toxicity.symbols(*(lambda s: (s[2], s[3]))(next(toxicity.slices(pa.array([text])))))
        return held.tobytes().strip(b"\0").split(b"\0")

    assert of("an i-d-i-o-t")[1] == of("an IDIOT!!")[1] == of("an i d i o t")[-1].replace(b"\0", b"") == of("an id1ot.")[1]


@pytest.mark.parametrize("text", ["", "plain words and 123 numbers, it's", " ".join(prose(i, 900) for i in range(8)), "a" * 70_000, "é ñ " * 12_000 + "b" * 40_000 + " tail", " " * 40_000 + "x", "x\n\n" * 15_000])
def test_bpe_whole_texts(spark, text):
    docs = docs_of(spark, [(1, text), (1, text), (2, None)])
    got = bpe.encode_table(docs).collect()
    enc = bpe.encoding(None)
    assert len(got) == 3 and [r.ids for r in got if r.doc_id == 1] == [enc.encode_ordinary(text)] * 2
    back = bpe.decode_table(bpe.encode_table(docs)).collect()
    assert all(bytes(r.bytes) == (text if r.doc_id == 1 else "").encode() for r in back)


def brute_spans(texts, least):
    seen, out = {}, []
    for i, t in sorted(texts, key=lambda x: (x[0] is not None, x[0] or 0)):
        b = (t or "").encode()
        for p in range(len(b) - least + 1):
            w = b[p : p + least]
            key = -1 if i is None else i
            seen[w] = min(seen.get(w, key), key)
    for i, t in texts:
        b, key = (t or "").encode(), -1 if i is None else i
        mark = bytearray(len(b))
        for p in range(len(b) - least + 1):
            if seen[b[p : p + least]] < key:
                mark[p : p + least] = b"\1" * least
        kept = bytes(c for c, m in zip(b, mark) if not m)
        out.append((i, len(b), sum(mark), sum(m and not (k and mark[k - 1]) for k, m in enumerate(mark)), hashlib.sha256(kept).hexdigest()))
    return collections.Counter(out)


@pytest.mark.parametrize("hot", [50_000, 3])
def test_repeated_spans(spark, mixed, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", hot)
    extra = [(200 + i, prose(50 + i, 6) + " the same long passage that many of the documents share word by word " + prose(80 + i, 6)) for i in range(12)]
    texts = mixed + extra + [(300, "\0" * 120), (301, "x" + "\0" * 90), (302, "ab" * 100), (303, "b" + "ab" * 60)]
    got = suffix_dedup.digest(suffix_dedup.repeated_spans(docs_of(spark, texts))).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_spans(texts, 50)


@pytest.mark.parametrize("hot", [50_000, 2])
def test_repeats_inside_one_document(spark, monkeypatch, hot):
    """A passage that a document repeats with the same bytes around it, and a smaller one holds with others; one id with two texts."""
    monkeypatch.setattr(suffix_dedup, "HOT_CLASSES", hot)
    passage = "the sixty bytes or so which these documents have in common."
    line = prose(70, 8) + " left " + passage + " right " + prose(71, 8) + "\n"
    texts = [(3, prose(72, 9) + " x " + passage + " y " + prose(73, 9)), (5, line * 2 + prose(74, 30) + line), (6, "before " + line), (7, prose(75, 5) + line), (7, prose(76, 50) + line * 2)]
    got = suffix_dedup.digest(suffix_dedup.repeated_spans(docs_of(spark, texts))).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_spans(texts, 50)
    groups = suffix_dedup.maximal_repeats(docs_of(spark, texts[:3])).collect()
    want = {(i, m.start()) for i, t in texts[:3] for m in re.finditer(re.escape(passage), t)}
    assert any({(o.doc, o.start + bytes(r.repeat).find(passage.encode())) for o in r.occurrences} == want for r in groups if passage.encode() in bytes(r.repeat))
    # one class only: the same bytes all around
    groups = suffix_dedup.maximal_repeats(docs_of(spark, [(1, "1" + passage * 2), (2, "2" + passage * 2)])).collect()
    assert groups and {o.doc for r in groups for o in r.occurrences} == {1, 2}


def test_maximal_repeats(spark):
    passage = "this passage of more than fifty bytes is in three of the texts"
    texts = [(1, "one " + passage + " end"), (2, "other " + passage + " stop"), (3, passage), (4, "nothing in common with them at all, not even a few words of it")]
    got = suffix_dedup.maximal_repeats(docs_of(spark, texts)).collect()
    assert got and all(len(r.repeat) == r.length >= 50 for r in got)
    whole = {i: t.encode() for i, t in texts}
    assert all(whole[o.doc][o.start : o.start + r.length] == bytes(r.repeat) for r in got for o in r.occurrences)
    assert any({o.doc for o in r.occurrences} == {1, 2, 3} for r in got)


def test_repeats_past_the_filter(spark, monkeypatch):
    """With a filter that half of the single anchors pass: right results, and no table or shuffle of contexts that holds them."""
    monkeypatch.setattr(suffix_dedup.bitmap, "MAX_BITS", suffix_dedup.bitmap.CHUNK_BITS)
    passage = prose(900, 12)
    texts = [(i, prose(1000 + i, 330) + (" " + passage + " " if i % 10 == 0 else " ") + prose(2000 + i, 60)) for i in range(200)]
    docs = docs_of(spark, texts)
    got = suffix_dedup.digest(suffix_dedup.repeated_spans(docs)).collect()
    assert collections.Counter(tuple(r) for r in got) == brute_spans(texts, 50)
    job = suffix_dedup.Repeats(docs, "doc_id", "text")
    seen = collections.Counter(r.anchor for r in job.classes.collect())
    assert 0 < sum(seen.values()) < 2000 and 0 < job.contexts()[0].count() < 2000


@pytest.mark.parametrize("rows", [1, 2, 3, 7, 1000])
def test_classes_of_anchors(rows):
    """Classes from batches of any size: kept are those that two documents have, and those of anchors with several and two documents."""
    r = random.Random(rows)
    parts = sorted((r.choice([r.randrange(200), 77]), r.randrange(5), r.randrange(6)) for _ in range(300))
    cols = [[a for a, _, _ in parts], [c for _, c, _ in parts], [d for _, _, d in parts], [d + (d == 2) for _, _, d in parts]]
    whole = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["anchor", "context", "first", "last"])
    got = [tuple(x.values()) for b in suffix_dedup._classes(whole.slice(i, rows) for i in range(0, 300, rows)) for x in b.to_pylist()]
    docs, first = collections.defaultdict(set), {}
    for a, c, lo, hi in zip(*cols):
        docs[a, c] |= {lo, hi}
    count = collections.Counter(a for a, _ in docs)
    want, least = {}, set()
    for a, c in sorted(docs):
        first[a] = first.get(a, -1) + 1
        held = set().union(*(docs[k] for k in docs if k[0] == a))
        row = (a, c, min(docs[a, c]), len(docs[a, c]) > 1, count[a] > 1, first[a])
        want[row] = None
        if len(docs[a, c]) > 1 or (count[a] > 1 and len(held) > 1):
            least.add(row)
    assert least <= set(got) <= set(want) and len(got) == len(set(got))
    assert rows < 1000 or len(got) - len(least) <= 5


def test_warc(spark):
    pages = spark.createDataFrame([(1, "http://a/", "<p>é</p>"), (2, "http://b/x\r\ny", "<p>é</p>"), (3, None, None), (4, "http://d/", ""), (5, "http://e/", "z\r\n\r\nWARC/1.1" * 5), (5, "http://e/", "z\r\n\r\nWARC/1.1" * 5), (None, "http://n/", "<p>é</p>")], "page_id long, url string, html string")
    index = warc.write(pages)
    assert index.count() == 7 and set(index.columns) == {"page_id", "file", "offset", "length", "url", "digest"}
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read(index).collect()), key=str)
    assert got == sorted([(1, "revisit", 2, 9), (2, "response", None, 9), (3, "revisit", 4, 0), (4, "response", None, 0), (5, "response", None, 65), (5, "revisit", 5, 65), (None, "revisit", 2, 9)], key=str)
    one = warc.select(spark, index, "http://e/%").where("record_type = 'response'").collect()
    assert bytes(one[0].payload) == b"z\r\n\r\nWARC/1.1" * 5 and one[0].payload_digest == base64.b32encode(hashlib.sha1(one[0].payload).digest()).decode()
    assert warc.round_trip(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.read(warc.write(pages, min_revisit_bytes=1000)).collect()} == {"response"}


def test_warc_ranges_join_neighbours():
    rows = [{"offset": 0, "length": 10}, {"offset": 10, "length": 5}, {"offset": 10**6, "length": 5}]
    assert [(a, b, len(g)) for a, b, g in warc.ranges(rows)] == [(0, 15, 2), (10**6, 10**6 + 5, 1)]


def test_licenses(spark):
    texts = [(1, "Words. Released under the MIT License.\nMore"), (2, "This work is licensed under the GNU General Public License, version 3."), (3, "nothing"), (4, None), (5, ""), (6, "Licensed under the Apache License, Version 2.0\nYou may not use this file except in compliance with the License.\nDistributed on an AS IS basis, without warranties or conditions of any kind."), (7, "X licensed under CC BY-NC 4.0. Licensed under the MIT License.")]
    got = sorted((r.doc_id, r.licence, r.rule) for r in licenses.scan(docs_of(spark, texts)).collect())
    assert got == [(1, "MIT", "notice"), (2, "GPL-3.0", "notice"), (6, "Apache-2.0", "full"), (7, "CC-BY-NC-4.0", "notice"), (7, "MIT", "notice")]


def test_licences_in_their_official_wording(spark):
    mit = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED."""
    apache = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""
    gpl = """This program is free software%s you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation."""
    bsd = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer."""
    mpl = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one."""
    ids = "\n".join("// SPDX-License-Identifier: " + x for x in ("MIT", "Apache-2.0", "GPL-3.0-or-later"))
    block = lambda t, sign: "\r\n".join(sign + x for x in t.split("\n"))
    texts = [(1, mit), (2, block(mit, " * ")), (3, block(mit, "REM ")), (4, apache), (5, block(apache, "# ")), (6, gpl % ":"), (7, block(gpl % ";", "// ")), (8, bsd), (9, mpl), (10, ids), (11, "\u0130 is licensed under the MIT License and licensed under CC BY 4.0 too"), (12, "Released under the MIT. License it")]
    got = [(r.doc_id, r.licence, r.rule) for r in licenses.scan(docs_of(spark, texts)).orderBy("doc_id", "start").collect()]
    want = [(1, "MIT", "full"), (2, "MIT", "full"), (3, "MIT", "full"), (4, "Apache-2.0", "full"), (5, "Apache-2.0", "full"), (6, "GPL", "grant"), (7, "GPL", "grant"), (8, "BSD", "partial"), (9, "MPL-2.0", "notice")]
    assert got == want + [(10, x, "notice") for x in ("MIT", "Apache-2.0", "GPL-3.0-or-later")] + [(11, "MIT", "notice"), (11, "CC-BY-4.0", "notice")]
    (_, _, lo, hi), *_ = licenses.identify(mpl)
    assert mpl[lo:hi].startswith("This Source") and mpl[lo:hi].endswith("v. 2.0")


def test_empty_tables(spark):
    none = docs_of(spark, [])
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([], "item_id long, text string")
    for df in (pii.detect(none), exact_dedup.exact_duplicates(none), exact_dedup.drop_exact_duplicates(none), jaccard_join.jaccard_components(none), jaccard_join.drop_near_duplicates(none), decontaminate.contaminated(none, bench), quality.scores(none, labels), toxicity.scores(none, labels), bpe.encode_table(none), suffix_dedup.repeated_spans(none), licenses.scan(none)):
        assert df.count() == 0


def test_shingle_sets_match_words():
    texts = ["A b c d e", "a B c d e", "a b c", "", "x", "a b c d a b c d a"]
    got = list(shingles.sets_of(pa.array(texts), 4))
    assert [len(s) for s in got] == [len(shingle_set(t, 4)) for t in texts] and (got[0] == got[1]).all() and got[2][0] not in got[0]


def brute_groups(texts, least):
    """All maximal repeats of the distinct texts: {(string, occurrences)} by sorting every suffix."""
    first = {}
    for i, t in sorted(texts):
        first.setdefault(t.encode(), i)
    suffixes = sorted((t[p:], i, p, t[p - 1] if p else None) for t, i in first.items() for p in range(len(t) - least + 1))
    common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    lcp = [common(a[0], b[0]) for a, b in zip(suffixes, suffixes[1:])]
    out = set()
    for k, n in enumerate(lcp):
        if n >= least:
            lo = hi = k
            while lo > 0 and lcp[lo - 1] >= n:
                lo -= 1
            while hi + 1 < len(lcp) and lcp[hi + 1] >= n:
                hi += 1
            held = suffixes[lo : hi + 2]
            left = {s[3] for s in held}
            if len({s[1] for s in held}) > 1 and (len(left) > 1 or None in left):
                out.add((held[0][0][:n], tuple(sorted((s[1], s[2]) for s in held))))
    return out


@pytest.mark.parametrize("sizes", [(60, 200), (50, 51, 99, 100, 101), (1000, 380, 76)])
def test_maximal_repeats_of_any_length(spark, sizes):
    """Passages of 50 to 1000 bytes in three texts and more, one inside another, with the same and with other bytes around; copies; repeats inside one text."""
    passages = [prose(300 + n, n)[:n] for n in sizes]
    texts = [(1, "x" + passages[0] + "y"), (2, "a" * 3 + passages[0] + "b" * 3), (3, "z" + "a" * 3 + passages[0] + "b" * 3 + "w")]
    texts += [(10 + k, prose(400 + k, 5) + p + prose(500 + k % 2, 4) + p[: len(p) - 3] + "!") for k, p in enumerate(passages * 3)]
    texts += [(40, texts[0][1]), (41, "".join(passages)), (42, "ab" * 60), (43, "c" + "ab" * 40), (44, ""), (45, passages[-1])]
    got = suffix_dedup.maximal_repeats(docs_of(spark, texts)).collect()
    groups = {(bytes(r.repeat), tuple((o.doc, o.start) for o in r.occurrences)) for r in got}
    assert groups == brute_groups(texts, 50) and len(got) == len(groups) and all(r.length == len(r.repeat) for r in got)


@pytest.mark.parametrize("unit, times", [("中文字" * 300 + "。", 60), ("ก็ดี้มาก" * 70, 100), ("it's we'll don't ", 4000), ("word 12345 -- ", 4000), ("́x​" * 50 + "\n \n", 400)])
def test_bpe_stitches_any_script(spark, unit, times):
    """Overlaps without a boundary, combining marks, contractions and white space on cuts."""
    text = "start " + unit * times
    want = bpe.encoding(None).encode_ordinary(text)
    assert bpe.encode(text) == want and "".join(bpe.stretches(text)) == text
    docs = docs_of(spark, [(1, text), (2, "short")])
    assert {r.doc_id: r.ids for r in bpe.encode_table(docs).collect()}[1] == want
    rows = sorted(tuple(r) for r in bpe.digest_table(docs).collect())
    assert rows == sorted(tuple(r) for r in bpe.digest(bpe.encode_table(docs)).collect())
    n, ids, raw = next(r[1:] for r in rows if r[0] == 1)
    assert (n, ids, raw) == (len(want), hashlib.sha256(" ".join(map(str, want)).encode()).hexdigest(), hashlib.sha256(text.encode()).hexdigest())


def test_bpe_chunks_of_mixed_scripts():
    r = random.Random(1)
    signs = ["中", "文", "。", "，", "ก", "็", "a", "b", "'", " ", "s", "\n", "1", "é", "́", "  ", "don't", "🙂", "\t"]
    for _ in range(60):
        some = r.sample(signs, r.choice([1, 3, 8, 19]))
        text = "".join(r.choice(some) for _ in range(r.randrange(20_000)))
        assert bpe.encode(text) == bpe.encoding(None).encode_ordinary(text)


def test_quality_votes_match_brute_force():
    """Every cosine, all sorted: the same scores as blocks and partial sorts."""
    texts = [prose(600 + i, 20 + i % 30) + (" good" if i % 2 else " bad bad bad") * 5 for i in range(240)]
    counts = np.vstack(list(quality.term_counts(pa.array(texts))))
    model = quality.train(counts[:200], [i % 2 for i in range(200)])
    got = quality.vote(model, counts)
    x = quality.weigh(counts, model["idf"]) @ model["basis"]
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(len(texts)):
        cosine = [float(np.dot(x[i], v)) for v in model["vectors"]]
        near = sorted(range(200), key=lambda j: -cosine[j])[: quality.NEIGHBOURS]
        weight = [max(cosine[j], 1e-6) ** quality.POWER for j in near]
        assert got[i] == pytest.approx(sum(w * model["labels"][j] for w, j in zip(weight, near)) / sum(weight), abs=1e-3)
    assert np.mean((got[200:] > 0.5) == (np.arange(200, 240) % 2 == 1)) > 0.9
    brute = collections.Counter(hashlib.md5(t.encode()[i : i + 3]).hexdigest() for t in texts[:1] for i in range(len(t.encode()) - 2))
    assert counts[0, : quality.TERMS].sum() == sum(brute.values())


def test_toxicity_kernel_has_norm_one_and_nystroem_gives_it_between_landmarks():
    words = [b"\0" + bytes(b - 96 for b in w) + b"\0" for w in (b"banana", b"idiot", b"moron", b"abababab", b"word", b"fool")]
    f = [toxicity.features(w) for w in words]
    k = toxicity.kernel(f, f)
    assert np.allclose(np.diag(k), 1) and (k <= 1 + 1e-9).all()
    whiten = toxicity.whitening(f)
    z = toxicity.nystroem(f, f, whiten)
    assert np.allclose(z @ z.T, k, atol=1e-4)
    table = np.zeros(1 << 20, np.float32)
    for key, v in f[3].items():
        table[key] += v
    held = np.frombuffer(b"".join(w[:-1] for w in words) + b"\0", np.uint8)
    first, value = toxicity.decisions(toxicity.Known(table), held)
    assert np.allclose(value, k[:, 3], atol=1e-5) and len(first) == len(words)


def test_toxicity_machine_separates_with_the_largest_margin():
    """The machine against plain steps down the same loss."""
    r = np.random.default_rng(2)
    x = np.r_[r.normal(1, 1, (40, 3)), r.normal(-1, 1, (40, 3))]
    y = np.r_[np.ones(40), -np.ones(40)]
    weight = np.full(80, 1 / 80)
    w, b = toxicity.linear_svm(x, y, weight, ridge=1e-2)
    loss = lambda v: (weight * np.maximum(0, 1 - y * (x @ v[:3] + v[3])) ** 2).sum() + 1e-2 * (v[:3] ** 2).sum() + 1e-4 * v[3] ** 2
    v = np.zeros(4)
    for _ in range(20_000):
        slack = weight * np.maximum(0, 1 - y * (x @ v[:3] + v[3])) * y
        v -= 0.05 * (np.r_[-2 * slack @ x, -2 * slack.sum()] + np.r_[2e-2 * v[:3], 2e-4 * v[3]])
    assert loss(np.r_[w, b]) <= loss(v) + 1e-6


def test_toxicity_of_insults_with_gaps_and_inserted_signs(spark):
    """Held-out texts whose insults are written as no training text writes them."""
    insults = ["idiot", "moron", "scumbag", "dimwit", "imbecile"]
    train = [(i, f"{prose(700 + i, 12)}. You {insults[i % 5]} {prose(800 + i, 4)}. {prose(900 + i, 9)}") for i in range(1, 400, 2)] + [(i, f"{prose(700 + i, 12)}. You reader {prose(800 + i, 4)}. {prose(900 + i, 9)}") for i in range(0, 400, 2)]
    shown = ["You i-d-i-o-t there", "You m o r o n there", "You scum.bag there", "You dim*wit there", "You imbbecile there", "You idi0t there", "You idxiot there", "You mor_on there"]
    asked = [(1000 + i, prose(40 + i, 8) + ". " + s) for i, s in enumerate(shown)] + [(2000 + i, prose(60 + i, 30)) for i in range(8)] + [(3000, None), (3001, "")]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in train], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in toxicity.scores(docs_of(spark, train + asked), labels).collect()}
    assert [i for i, _ in asked if 1000 <= i < 2000 and got[i].predicted != 1] == []
    assert not any(got[i].predicted for i, _ in asked if i >= 2000) and got[3000].score == got[3001].score


LICENCE_WORDS = [w for all_of in licenses.SENTENCES.values() for s in all_of for w in s.split()]


def test_licence_sentences_match_a_plain_search():
    """Known sentences at every word, the longest first, against the one expression; every one has a marker."""
    assert all(re.search(licenses._MARKED, s) for s in licenses._KNOWN)
    r = random.Random(4)
    for _ in range(300):
        parts = [r.choice([r.choice(list(licenses._KNOWN)), " ".join(r.choices(LICENCE_WORDS, k=3)), "filler words"]) for _ in range(6)]
        text = " ".join(p.upper() if r.random() < 0.3 else p for p in parts)
        words, want, i, since = text.lower().split(), [], 0, 0
        while i < len(words):
            hit = max((s for s in licenses._KNOWN if words[i : i + len(s.split())] == s.split()), key=len, default=None)
            if hit and not (licenses._KNOWN[hit].endswith("-notice") and {"not", "never"} & set(words[since:i])):
                want.append(licenses._KNOWN[hit])
            i += len(hit.split()) if hit else 1
            since = i if hit else since
        assert [x[1] for x in licenses.identify(text) if not x[1].startswith("notice:")] == want


def test_licence_rules_and_denials(spark):
    bsd3 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that:
1. Redistributions of source code must retain the above copyright notice, this list of conditions.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions.
3. Neither the name of the holder nor the names of its contributors may be used to endorse or promote products
   derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES"""
    lgpl = """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""
    isc = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES"""
    texts = [(1, bsd3), (2, bsd3.replace("3. Neither", "x").replace("endorse or promote", "sell")), (3, lgpl), (4, isc), (5, "This is NOT released under the MIT license."), (6, "It isn't licensed under the Apache License, Version 2.0."), (7, "Not only licensed under the MIT license"), (8, "SPDX-License-Identifier: BSD-3-Clause"), (8, "SPDX-License-Identifier: BSD-3-Clause"), (None, "licensed under the MIT license " + prose(1, 30_000))]
    got = sorted(((r.doc_id, r.licence, r.rule) for r in licenses.scan(docs_of(spark, texts)).collect()), key=str)
    want = [(1, "BSD-3-Clause", "full"), (2, "BSD-2-Clause", "full"), (3, "LGPL-2.1-or-later", "full"), (4, "ISC", "full"), (7, "MIT", "notice"), (8, "BSD-3-Clause", "notice"), (8, "BSD-3-Clause", "notice"), (None, "MIT", "notice")]
    assert got == sorted(want, key=str)


def test_decontamination_of_short_and_dense_items(spark):
    """Items of few words, of numbers mostly, of several widths; slots that fail leave windows without slots alone; repeated items and rows, null ids."""
    dense = "Add 12 and 30 and 45 and 77 and 80 and 91 and 15 and 66"
    plain = "the small boat crossed the wide river slowly before the storm reached it"
    items = [(1, "what is 12 plus 30"), (2, dense), (2, dense), (3, plain), (None, "seven grey geese flew over our quiet house today"), (5, "one two three four five six")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [(1, "so what is 12 plus 30 now"), (2, "so what is 44 plus 95 now"), (3, "x " + dense + " y"), (4, dense.replace("45", "46")), (5, plain.upper() + " " + prose(1, 4000)), (6, prose(2, 50)), (7, None), (None, "seven grey geese flew over our quiet house today"), (8, "one two three four five six"), (8, "one two three four five six"), (9, "one two nine four five six")]
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs_of(spark, texts), bench).collect()}
    assert got >= {(1, 1), (2, 1), (3, 2), (5, 3), (None, None), (8, 5)} and not {6, 7, 9} & {d for d, _ in got}
    left = decontaminate.drop_contaminated(docs_of(spark, texts), bench)
    assert left.columns == docs_of(spark, []).columns and {6, 7, 9} <= {r.doc_id for r in left.collect()}
    assert decontaminate.contaminated(docs_of(spark, []), bench).count() == 0
    exact = spark.createDataFrame([(1, "alpha beta")], "item_id long, text string")
    assert decontaminate.contaminated(docs_of(spark, [(1, "x alpha beta y"), (2, "beta alpha")]), exact, shortest=1).count() == 1


def test_clashing_columns_repeated_and_null_ids(spark, mixed):
    """All operators on a table with every awkward row, and with columns named like their working columns."""
    docs = docs_of(spark, mixed + mixed[:3] + [(None, None), (None, "x")]).selectExpr("*", "1 as id", "2 as score", "3 as good", "4 as kept", "5 as said", "6 as text_hash", "7 as h", "8 as best", "9 as held_out")
    n = docs.count()
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 20)] + [(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([(1, prose(2, 30))], "item_id long, text string")
    for rows in (pii.detect(docs), exact_dedup.exact_duplicates(docs), jaccard_join.jaccard_components(docs), quality.scores(docs, labels), toxicity.scores(docs, labels), bpe.encode_table(docs), bpe.digest_table(docs), suffix_dedup.repeated_spans(docs)):
        assert rows.count() == n
    for rows in (exact_dedup.drop_exact_duplicates(docs), jaccard_join.drop_near_duplicates(docs), decontaminate.drop_contaminated(docs, bench), quality.keep_good(docs, labels)):
        assert rows.columns == docs.columns and 0 < rows.count() <= n
    assert licenses.scan(docs).count() == 0
    scored = collections.defaultdict(set)
    for r in quality.scores(docs, labels).join(docs.select("doc_id", "text"), "doc_id").collect():
        scored[r.doc_id].add(r.score)
    assert all(len(scored[i]) == 1 for i in (4, 5, 12))
    named = docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id").cast("string")))
    assert exact_dedup.drop_exact_duplicates(named).count() == exact_dedup.drop_exact_duplicates(docs).count()


def test_warc_with_other_columns_and_stores(spark):
    pages = spark.createDataFrame([(i, "http://a/%d" % i, "<p>%s</p>" % prose(i % 3, 2000), "clash", 7) for i in range(9)], "page_id long, url string, html string, file string, offset int")
    got = warc.round_trip(pages).collect()
    assert len(got) == 9 and sum(r.record_type == "response" for r in got) == 3
    assert warc._open("/tmp/x")[1] == "/tmp/x" and warc._open("file:/tmp/x")[1] == "/tmp/x" and warc._open("dbfs:/a/b")[1] == "/dbfs/a/b"
