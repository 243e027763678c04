"""Ranked search, exact duplicates and the filter audit against plain versions and on odd tables."""

import hashlib
import math
import random
import re
import string
import uuid
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from gondola.llm import decontam, doubling, exact, queries, repeats, search, secrets, tries

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
WORD = re.compile("[^\x20\x09-\x0d]+")
ODD = [(1, None), (2, None), (3, ""), (None, "same text here"), (None, "same text here"), (4, "same text here"), (4, "same text here"), (9, "same text here"), (5, "A$B " * 30_000), (6, "ÉÉÉ é 日本 x"), (7, " \t\n"), (8, "x" * 200_000), (10, "x" * 200_000 + "y")]


def terms(text):
    return TERM.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def plain_search(docs, items, top=20):
    texts = [terms(t) for _, t in docs]
    n, size = sum(1 for t in texts if t), sum(map(len, texts))
    df = Counter(w for t in texts for w in set(t))
    asked = defaultdict(list)
    for i, t in items:
        asked[i] += terms(t)
    out = []
    for i, words in asked.items():
        scores = []
        for (d, _), own in zip(docs, texts, strict=True):
            tf, m = Counter(own), 75 + (25 * len(own) * n) // max(1, size)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[w] + 1))) * ((10**9 * tf[w]) // (1000 * tf[w] + 12 * m)) for w in words if tf[w])
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(i, rank, d, -s) for rank, (s, _, _, d) in enumerate(sorted(scores)[:top], 1)]
    return sorted(out, key=str)


def rows_of(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


@pytest.fixture
def wide(spark):
    """Odd documents with columns that clash with the operators' own."""
    def make(rows):
        return spark.createDataFrame([(i, t, "s" if k % 3 else None) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("rank", "score", "mask", "part", "kept", "n", "best", "digest", "shard", "item_id", "terms")})
    return make


def test_ranked_search_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    assert rows_of(queries.op11_block_max_maxscore(spark, SF), "item_id", "rank", "doc_id", "score") == plain_search(docs, items)


@pytest.mark.parametrize("rows", [[], ODD])
def test_ranked_search_on_odd_tables(spark, wide, rows):
    items = [(1, "same same HERE"), (1, "text"), (2, None), (3, "..."), (4, "é 日本 absent"), (None, "x")]
    table = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    assert rows_of(search.ranked_search(wide(rows), table), "item_id", "rank", "doc_id", "score") == plain_search(rows, items)
    assert search.ranked_search(wide(rows), table.limit(0)).count() == 0


def test_pruning_keeps_results_and_skips_blocks(monkeypatch):
    """Many shards and a small heap: what is pruned never changes the best, and blocks stay packed."""
    rng, seen = random.Random(4), {"unpacked": 0, "blocks": 0}
    vocabulary = [f"w{k}" for k in range(60)]
    docs = [(k, " ".join(vocabulary[min(59, int(rng.expovariate(0.12)))] for _ in range(rng.randint(1, 80)))) for k in range(4000)]
    texts = [terms(t) for _, t in docs]
    n, size = len(docs), sum(map(len, texts))
    df = Counter(w for t in texts for w in set(t))
    number = {w: k for k, w in enumerate(vocabulary)}
    shards = []
    for a in range(0, len(docs), 1000):
        own = texts[a : a + 1000]
        h, of = np.array([number[w] for t in own for w in t], np.uint64), np.repeat(np.arange(len(own)), [len(t) for t in own])
        shards.append(search._shard_row(a, search.pa.array(range(a, a + len(own)), search.pa.int64()), np.array([len(t) for t in own]), h, of, (n, size)))
    most = defaultdict(int)
    for b in shards:
        for t, m in zip(b.column("terms")[0].as_py(), b.column("most")[0].as_py(), strict=True):
            most[t] = max(most[t], m)
    for words in (["w0", "w1", "w40"], ["w2", "w2", "w50", "w55"], ["w0"], ["w30", "w31", "w0", "w1", "w2", "w3"]):
        asked = Counter(number[w] for w in words)
        weight = lambda t: asked[t] * math.floor(1000 * math.log((2 * n + 2) / (2 * df[vocabulary[t]] + 1)))
        names = np.array(sorted(asked))
        query, heap = search.Query(names, np.array([weight(t) for t in names]), np.array([most[t] for t in names])), search.Heap(5)
        for b in shards:
            shard = search.Shard.of(b, 0)
            search.search_shard(shard, query, heap)
            seen["unpacked"] += len(shard.unpacked)
            seen["blocks"] += sum(int(shard.list_at[k + 1] - shard.list_at[k]) for k in np.flatnonzero(np.isin(shard.terms, names)))
        assert [(1, r + 1, i, s) for r, (s, _, i) in enumerate(heap.rows)] == sorted(plain_search(docs, [(1, " ".join(words))], 5), key=lambda r: r[1])
    assert seen["unpacked"] < 0.8 * seen["blocks"]


def test_blocks_round_trip():
    for docs, tf in (([5], [1]), ([0, 1, 300, 70_000], [1, 2, 70_000, 255]), (list(range(128)), [3] * 128)):
        a, b = search.unpack_block(memoryview(search.pack_block(np.array(docs), np.array(tf))))
        assert a.tolist() == docs and b.tolist() == tf


def plain_exact(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    out = []
    for t, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = max(known) if known else None
        for k, i in enumerate(sorted(ids, key=lambda x: -1 if x is None else x)):
            out.append((i, best, len(ids), k == len(ids) - 1, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


COLUMNS12 = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


@pytest.mark.parametrize("heavy", [1, 4, exact.HEAVY])
def test_exact_duplicates(spark, wide, heavy):
    """All ways of splitting the work give the same rows; a hot text of a third of all is found as heavy."""
    rows = [*ODD, *((100 + k, "copied") for k in range(60)), *((300 + k, f"own {k}") for k in range(90))]
    assert rows_of(exact.exact_duplicates(wide(rows).repartition(5), heavy), *COLUMNS12) == plain_exact(rows)
    docs = wide(rows)
    left = exact.remove_exact_duplicates(docs, heavy)
    assert left.columns == docs.columns and left.count() == len({t or "" for _, t in rows})
    assert exact.exact_duplicates(wide([]), heavy).count() == 0 and exact.remove_exact_duplicates(wide([]), heavy).count() == 0
    if heavy == 4:
        digests = exact._digested(wide(rows), "doc_id")
        assert exact.heavy_winners(digests, heavy).filter("group_size = 60").select("best.doc_id").collect()[0][0] == 159


def test_exact_duplicates_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows_of(queries.op12_heavy_hitters(spark, SF), *COLUMNS12) == plain_exact(rows)


def test_misra_gries_bounds():
    rng = random.Random(2)
    values = [b"hot"] * 400 + [b"%d" % rng.randrange(3000) for _ in range(800)]
    rng.shuffle(values)
    found = exact.MisraGries(10)
    for k in range(0, len(values), 7):
        found.add(Counter(values[k : k + 7]))
    assert len(found.counters) <= 10 and found.n == 1200
    real = Counter(values)
    assert all(real[v] - 1200 / 11 <= c <= real[v] for v, c in found.counters.items()) and b"hot" in found.counters


def plain_masks(rows):
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        words = WORD.findall(t)
        bits = [len(words) < 50, 100 * len(set(words)) < 65 * len(words), 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), any(c in "#$%&*|" for c in t), i is not None and i > least[t]]
        out.append((i, sum(b << k for k, b in enumerate(bits))))
    return out


@pytest.mark.parametrize("rows", [[], ODD, [(k, ("shared beginning " * 40 + str(k % 7)) * 3) for k in range(60)]])
def test_filter_masks(spark, wide, rows, monkeypatch):
    found = tries.filter_masks(wide(rows).repartition(3))
    assert rows_of(found, "doc_id", "mask") == sorted(plain_masks(rows), key=str)
    assert rows_of(found.groupBy("part").count(), "part") == sorted({("s",) if k % 3 else ("",) for k in range(len(rows))})


def test_small_local_tries_change_nothing(wide, monkeypatch):
    rows = [(k, f"text {k % 5} of the same " * 20) for k in range(40)]
    batch = search.pa.RecordBatch.from_arrays([search.pa.array([i for i, _ in rows]), search.pa.array(["p"] * 40), search.pa.array([t for _, t in rows])], names=["doc_id", "part", "text"])
    for room in (1, 1 << 20):
        monkeypatch.setattr(tries, "LOCAL_BYTES", room)
        out = list(tries._faulty_rows(type("B", (), {"value": set()}))(iter([batch])))
        done = [(i, m) for b in out for i, m, t in zip(*(b.column(c).to_pylist() for c in ("doc_id", "mask", "text")), strict=True) if t is None]
        more = [b.filter(search.pa.array([t is not None for t in b.column("text").to_pylist()], search.pa.bool_())) for b in out]
        done += [(i, m) for b in tries._flagged(iter(more)) for i, m in zip(b.column("doc_id").to_pylist(), b.column("mask").to_pylist(), strict=True)]
        assert sorted(done) == sorted(plain_masks(rows))


def test_radix_trie_against_a_dict():
    rng = random.Random(1)
    trie, want = tries.RadixTrie(), defaultdict(list)
    for k in range(3000):
        text = bytes(rng.choice(b"ab\x00\xff") for _ in range(rng.randint(0, 9)))
        trie.insert(text, k, k)
        want[text].append(k)
    assert {t: ids for t, ids, _ in trie.terminals()} == want
    assert {r for r, again in trie.flags() if not again} == {ids[0] for ids in want.values()}


def test_filter_interactions(spark):
    docs = [(1, "p", 0), (2, "p", 0b10001), (3, "p", 0b00001), (4, "", 0b11111), (5, "p", 0b01000), (5, "p", 0b10000), (None, "", 0)]
    marks = [(1, 1, 0), (2, 1, 1), (2, 0, 0), (3, None, 1), (5, 1, 0)]
    found = tries.filter_interactions(spark.createDataFrame(docs, "doc_id long, part string, mask int"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")).collect()
    good, toxic = {1, 2, 5}, {2, 3}
    want, shapley = {}, Counter()
    for part in ("p", ""):
        own = [(i, m) for i, p, m in docs if p == part]
        for order in permutations("ABCDE"):
            before = 0
            for step, f in enumerate(order, 1):
                bit = 1 << "ABCDE".index(f)
                lost = [i for i, m in own if m & bit and not m & before]
                want[part, "".join(order), step] = [sum(not m & (before | bit) for _, m in own), len(lost), sum(bool(m & bit and m & before) for _, m in own), sum(m == bit for _, m in own), sum(i in good for i in lost), sum(i in toxic for i in lost)]
                shapley[part, f] += len(lost)
                before |= bit
    assert {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost] for r in found} == want
    assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in found)


def test_filter_audit_query(spark):
    rows = [(r["doc_id"], r["source"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    masks = dict(plain_masks([(i, t) for i, _, t in rows]))
    want = Counter()
    for i, source, _ in rows:
        for order in permutations("ABCDE"):
            gone = next((k for k, f in enumerate(order) if masks[i] >> "ABCDE".index(f) & 1), None)
            if gone is not None:
                want[source or "", "".join(order), gone + 1] += 1
    found = queries.op13_filter_audit(spark, SF).collect()
    assert len(found) == 600 * len({s or "" for _, s, _ in rows})
    assert all(r.removed == want[r.part, r.filter_order, r.step] for r in found)


def test_one_word_items_match_documents_with_the_word(spark):
    """A benchmark item of one word is found in each document that holds it, and nowhere else; one without words never is."""
    docs = spark.createDataFrame([(1, "a rare Word here"), (2, "wording words"), (3, None), (4, "WORD")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "word"), (8, "..."), (9, None)], "item_id long, text string")
    found = decontam.contaminated(docs, items).select("doc_id", "item_id", "n_tokens").collect()
    assert sorted(map(tuple, found)) == [(1, 7, 1), (4, 7, 1)]


def test_keys_are_random_and_numbers_are_not(spark):
    """Held-out strings of 16 characters and more: recall on keys, false positives on numbers, times, UUIDs, names and words."""
    rng = random.Random(7)
    pick = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    letters, digits = string.ascii_letters, string.digits
    keys = [pick(letters + digits, n) for n in (16, 20, 24, 40) for _ in range(100)] + [pick(string.ascii_lowercase + digits, 20) for _ in range(100)] + [pick(string.ascii_uppercase + digits, 20) for _ in range(100)] + ["Zx9Qw7Lp3Vb8Nm2K"]
    ordinary = [pick(digits, n) for n in (16, 18, 20) for _ in range(100)] + ["1111111111111111", "2024010112345678", "9780306406157123", "4785380592391139"]
    ordinary += [f"20{rng.randint(10, 39)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{rng.randint(10, 23)}-{rng.randint(10, 59)}-00Z" for _ in range(100)] + [str(uuid.UUID(int=rng.getrandbits(128))) for _ in range(200)]
    ordinary += [f"978-{rng.randint(0, 9)}-{rng.randint(1000, 9999)}-{rng.randint(1000, 9999)}-{rng.randint(0, 9)}" for _ in range(100)] + [f"ORD-{rng.randint(2000, 2030)}-{rng.randint(0, 10**7):08}" for _ in range(100)]
    ordinary += ["max_value_of_the_thing", "getUserAccountName", "HTTPServerConnectionPool", "TRAINING_WORDS_DOCS", "src/main/java/org", "ThisIsACamelCaseName", "version-2-final-draft", "file_2024_01_01_backup"]
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = secrets.train(secrets.labelled_strings(docs.filter("doc_id < 800")))
    rows = spark.createDataFrame([(k, f"see {s} here") for k, s in enumerate(keys + ordinary)], "doc_id long, text string")
    found = {r["doc_id"]: [(s["start"], s["end"]) for s in r["secret_spans"] if s["kind"] == 3] for r in secrets.scan_secrets(rows, model).select("doc_id", "secret_spans").collect()}
    hits = [found[k] == [(4, 4 + len(s))] for k, s in enumerate(keys)]
    assert sum(hits) >= 0.98 * len(keys) and hits[-1]
    assert not any(found[k] for k in range(len(keys), len(keys) + len(ordinary)))
    # Documents that the model hasn't seen: personal numbers stay, and so does prose.
    added = secrets.scan_secrets(docs.filter("doc_id >= 800"), model).select(F.explode("secret_spans").alias("s"), "text").filter("s.kind = 3").select(F.substring("text", F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("x")).collect()
    assert [r["x"] for r in added if r["x"].isdigit()] == [] and len(added) <= 2


def test_prefix_doubling_finds_the_positions_of_brute_force_and_of_anchors(spark):
    rng = random.Random(6)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(420))
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").filter("doc_id < 40").collect()]
    rows += [(1000, passage), (1001, "x" + passage[:260]), (1002, passage[150:]), (1003, "z" * 230), (1004, "z" * 199), (1005, None), (1006, ""), (1007, "é" * 120)]
    raw = {k: (t or "").encode() for k, t in rows}
    seen = Counter(t[i : i + 200] for t in raw.values() for i in range(len(t) - 199))
    want = {(k, i) for k, t in raw.items() for i in range(len(t) - 199) if seen[t[i : i + 200]] > 1}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {tuple(r) for r in doubling.repeated_positions(docs).collect()} == want and len(want) > 300
    gone = {k: sum(any((k, j) in want for j in range(i - 199, i + 1)) for i in range(len(t))) for k, t in raw.items() if k >= 1000}
    assert {r["doc_id"]: r["n_removed"] for r in repeats.remove_repeats(docs).collect() if r["doc_id"] >= 1000} == gone
    assert doubling.repeated_positions(docs.limit(0)).count() == 0
