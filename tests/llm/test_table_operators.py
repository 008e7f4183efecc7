"""Sharding, substrings, mixing, neighbours, decontamination, near copies: against brute force."""

import hashlib
import math
import random
import re
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evalguard.llm import anchors, common, decontaminate, hamming_index, jaccard_join, mixing, queries, sharding, substring_dedup, textvec
from evalguard.llm.queries import ORACLES

SF = "/root/testdata/sf0.001"


# ---- sharding


def draw(doc_id, s):
    key = hashlib.md5(f"{'null' if doc_id is None else doc_id}:{s.region}:{s.rack}:{s.id}".encode()).hexdigest()[:13]
    return -math.log((int(key, 16) + 0.5) / 16**13) / s.weight


def test_shards_equal_the_least_draw_and_slots_have_no_gap(odd, odd_rows, empty):
    old, new = sharding.topology(24), sharding.topology(25)
    rows = sharding.shard_documents(odd, old, new, buckets=3).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in rows) == sorted((r[0] or -1, len((r[1] or "").encode()) + 8) for r in odd_rows)
    for r in rows:
        assert r["shard"] == min(old, key=lambda s: draw(r["doc_id"], s)).id
        assert r["grown_shard"] == min(new, key=lambda s: draw(r["doc_id"], s)).id
        assert r["grown_shard"] in (r["shard"], 24) and (r["region"], r["rack"]) == (old[r["shard"]].region, old[r["shard"]].rack)
    for shard in {r["shard"] for r in rows}:
        slots = sorted(r["slot"] for r in rows if r["shard"] == shard)
        assert slots == list(range(len(slots)))
    assert sharding.shard_documents(empty, old).count() == 0


def test_weights_move_rows_only_into_the_heavier_shard(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    a = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, sharding.topology(12)).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_documents(docs, sharding.topology(12, [3.0 if i == 5 else 1.0 for i in range(12)])).collect()}
    assert {b[i] for i in a if a[i] != b[i]} == {5} and 2.2 < sum(s == 5 for s in b.values()) / sum(s == 5 for s in a.values()) < 3.2


# ---- repeated substrings


def brute_repeats(rows, length):
    seen = defaultdict(int)
    for _, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            seen[b[i : i + length]] += 1
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if seen[b[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        out.append((d, len(b), sum(gone), len(re.findall(b"\1+", bytes(gone))), bytes(x for x, y in zip(b, gone, strict=True) if not y)))
    return sorted(out, key=str)


@pytest.mark.parametrize("options", [{}, {"bucket_pieces": 40}, {"hot_pieces": 3}])
def test_repeats_equal_brute_force(spark, odd_rows, options):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdefgh é") for _ in range(n))
    passage = some(150)
    rows = [(r[0], (r[1] or "")[:4000] if r[1] is not None else None) for r in odd_rows] + [(100 + i, some(120) + passage + some(120)) for i in range(8)] + [(200, "xyz" + "ab" * 400 + "q"), (201, some(199)), (202, "a" * 900)]
    for i in range(8):
        t = list(rows[0][1])
        t[rng.randrange(len(t))] = "Z"
        rows.append((300 + i, "".join(t)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = substring_dedup.remove_repeats(df, **options).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept").collect()
    assert sorted(((*tuple(r)[:4], bytes(r["kept"])) for r in got), key=str) == brute_repeats(rows, 200)


def test_repeats_of_an_empty_table(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_anchors_equal_brute_force():
    rng = np.random.default_rng(0)
    for data in (rng.integers(0, 3, 400).astype(np.uint8), np.tile(np.frombuffer(b"Shti ", np.uint8), 100), np.zeros(500, np.uint8), rng.integers(0, 250, 200).astype(np.uint8), rng.integers(0, 9, 199).astype(np.uint8)):
        t = anchors.Text(data)
        h = t.grams(anchors.GRAM)
        want = []
        for i in range(len(data) - 199):
            p = i + int(np.argmin(h[i : i + 201 - anchors.GRAM]))
            if want and want[-1][1] == p:
                want[-1][3] = i
            else:
                want.append([h[p], p, i, i])
        assert [list(x) for x in zip(*anchors.runs(t, 200), strict=True)] == want


def test_column_order_keeps_common_prefixes():
    rng = random.Random(8)
    pieces = [bytes(rng.choice(b"ab") for _ in range(12)) for _ in range(40)]
    flags = substring_dedup.repeated_strings(pieces, np.zeros(40, np.int64), np.zeros(40, np.int64), np.full(40, 7), length=5)
    for i, p in enumerate(pieces):
        for k in range(8):
            assert flags[i][k] == any(q[k : k + 5] == p[k : k + 5] for j, q in enumerate(pieces) if j != i)


# ---- mixing


def plain(df):
    df = df[sorted(df.columns)]
    return sorted(tuple("null" if x is None or x != x else str(round(float(x), 6)) if isinstance(x, float) else str(x) for x in r) for r in df.itertuples(index=False, name=None))


def test_schedule_equals_sql(spark):
    c = duckdb.connect()
    c.sql(f"create view documents as select * from '{SF}/documents.parquet'")
    got = queries.op5_temperature_mixing(spark, SF).toPandas()
    assert plain(got) == plain(c.sql(ORACLES["op5_temperature_mixing"]).df())


def test_weights_meet_their_targets(spark):
    sources = spark.createDataFrame([("a", 1000), ("b", 100), ("c", 10), ("d", 0)], "key string, tokens long")
    r = {x["key"]: x for x in mixing.weigh(sources, mixing.exponent_for_repetition(sources, 4.0)).collect()}
    assert max(r[k]["quota"] / r[k]["tokens"] for k in "abc") == pytest.approx(4, abs=1e-6) and r["a"]["quota"] == pytest.approx(1000, abs=1e-5) and r["d"]["quota"] == 0
    a = mixing.exponent_for_entropy(sources, 0.8)
    w = [x["weight"] for x in mixing.weigh(sources, a).collect() if x["weight"]]
    assert -sum(x * math.log(x) for x in w) == pytest.approx(0.8, abs=1e-6) and sum(w) == pytest.approx(1)


def test_mixing_loses_no_document_and_repeats_small_sources(spark, odd, odd_rows, empty):
    mixed = mixing.mix(odd, max_epochs=3.0)
    assert mixed.columns == odd.columns
    key = lambda r: (r["doc_id"], r["text"])
    got = [key(r) for r in mixed.collect()]
    assert set(got) == {(r[0], r[1]) for r in odd_rows} and len(got) > len(odd_rows)
    assert mixing.mix(empty).count() == 0 and mixing.schedule(empty).count() == 0
    plan = mixing.schedule(odd, max_epochs=3.0).collect()
    first = [r for r in plan if r["epoch"] == 0]
    assert len(first) == len(odd_rows)
    few = mixing.schedule(odd, budget=100.0).collect()
    assert 0 < len(few) < len(odd_rows)


# ---- neighbours


def vectors(rng, n, dim=16):
    x = rng.normal(size=(n, dim)).astype(np.float32)
    x[5] = x[6] = x[7]  # ties
    return x


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = vectors(rng, 600)
    rows = [(i, [float(v) for v in x[i]]) for i in range(600)]
    rows += [(600, None), (601, [0.0] * 16), (602, [float("nan")] * 16), (603, [1.0]), (604, [None] + [1.0] * 15), (605, [float("inf")] * 16), (None, [1.0] * 16), (40, rows[40][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("clash"))
    got = hamming_index.nearest(df, F.col("vec_id") % 20 == 0, 20).collect()
    found = defaultdict(list)
    for r in sorted(got, key=lambda r: r["rank"]):
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    ids = np.array([*range(600), 40])
    every = np.concatenate([x, x[40:41]]).astype(np.float64)
    hits = 0
    assert set(found) == set(range(0, 600, 20))
    for q, rows_ in found.items():
        score = (every * x[q].astype(np.float64)).sum(axis=1)
        score[ids == q] = -np.inf
        want = ids[np.lexsort((ids, -score))][:20].tolist()
        hits += len(set(want) & {i for i, _ in rows_})
        assert len(rows_) == 20 and rows_ == sorted(rows_, key=lambda p: (-p[1], p[0])) and all(abs(s - float(x[i].astype(float) @ x[q].astype(float))) < 1e-9 for i, s in rows_)
    assert hits >= 0.9 * 20 * len(found)
    few = hamming_index.nearest(df.where("vec_id < 5"), F.col("vec_id") % 20 == 0, 20).collect()
    assert [r["rank"] for r in sorted(few, key=lambda r: r["rank"])] == [1, 2, 3, 4]
    assert hamming_index.nearest(df.where("vec_id > 9999"), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_on_the_smallest_table(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas().sort_values("vec_id")
    x, ids = np.stack(e.embedding.values).astype(np.float64), e.vec_id.values
    got = queries.op6_multi_index_hashing(spark, SF).toPandas().groupby("query_id").vec_id.apply(set)
    hits = 0
    for i in ids[ids % 20 == 0]:
        score = x @ x[ids == i][0]
        score[ids == i] = -9
        hits += len(set(ids[np.lexsort((ids, -score))][:20]) & got[i])
    assert hits >= 0.9 * 20 * len(got)


def test_index_returns_every_code_within_the_radius():
    rng = np.random.default_rng(3)
    codes = hamming_index.learn(rng.normal(size=(300, 16)), 300)
    shard = hamming_index.Shard(np.arange(300), rng.normal(size=(300, 16)), codes)
    for radius in (0, 5, 12, 20, 64):
        word = shard.words[7]
        want = np.flatnonzero(np.bitwise_count(shard.words ^ word).sum(axis=1) <= radius)
        assert shard.within(word, radius).tolist() == want.tolist()


# ---- decontamination

QUESTION = "In a field Alice has 12 apples and gives 5 km of rope to Bob before 12 people eat the rest."


def test_reparameterised_questions_are_found_and_inconsistent_ones_not(spark, odd, empty):
    docs = spark.createDataFrame([(1, "words before it. " + QUESTION + " and after"), (2, QUESTION.replace("12", "99").replace("Alice", "Carol").replace("km", "miles")), (3, QUESTION.replace("12 people", "98 people").replace("12", "99")), (4, QUESTION.lower().replace(" ", "\n")), (5, "In a field there is nothing."), (None, None), (6, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(7, QUESTION), (7, QUESTION), (8, None), (9, "too short"), (None, QUESTION), (10, "five words are just enough")], "item_id long, text string")
    got = {r["doc_id"]: r["exact"] for r in decontaminate.contaminated(docs, bench).where("item_id = 7").collect()}
    assert {k: v for k, v in got.items() if k != 4} == {1: True, 2: False}
    assert decontaminate.clean(docs, bench).where("doc_id in (3, 5, 6) or doc_id is null").count() == 4
    assert decontaminate.contaminated(odd, bench).count() == 0 and decontaminate.clean(odd, bench).columns == odd.columns
    assert decontaminate.marked(empty, bench).count() == 0 and decontaminate.marked(docs, bench.where("item_id = 99")).count() == 0


def test_passages_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    norm = lambda t: re.findall(r"\w+", t.lower())
    index = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect():
        w = norm(r["text"])
        for i in range(len(w) - 7):
            index[tuple(w[i : i + 8])].add(r["item_id"])
    want = defaultdict(set)
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        w = norm(r["text"])
        for i in range(len(w) - 7):
            want[r["doc_id"]] |= index.get(tuple(w[i : i + 8]), set())
    got = {r["doc_id"]: set(r["item_ids"]) for r in queries.op9_template_decontamination(spark, sf).collect()}
    assert got == {k: v for k, v in want.items() if v}


LONG = QUESTION[:-1] + " while Carol counts 2019 pears near the old mill and later Dave carries 2019 stones over the long bridge for his uncle in town."


def found(spark, texts, item=QUESTION):
    """{number of the text: (coverage, exact)} of the texts in one task that hold the item."""
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame([(7, item)], "item_id long, text string")
    return {r["doc_id"]: (round(r["coverage"], 2), r["exact"]) for r in decontaminate.contaminated(docs, bench).collect()}


@pytest.mark.parametrize("odd_text", ["\u0130", "\u212a \u212b \u2126 \u1e9e", "\u023a", "\u0130\u023a and", ""])
def test_names_do_not_depend_on_the_texts_beside(spark, odd_text):
    _, alone, _ = decontaminate.template(pa.array([QUESTION]))
    w, t, slot = decontaminate.template(pa.array([odd_text, QUESTION]))
    assert t[w.bounds[1] :].tolist() == alone.tolist() and slot[w.bounds[1] :].sum() == 6
    assert found(spark, [odd_text, QUESTION, QUESTION.replace("Alice", "Carol")]) == {1: (1.0, True), 2: (1.0, False)}


def test_copies_in_other_case_or_wrapping_are_found(spark):
    texts = [QUESTION.lower().replace(" ", "\n"), QUESTION.upper(), QUESTION.title(), QUESTION.replace(" Alice", "\nAlice").replace(" Bob", "\nBob"), "no question at all, of more than eight words"]
    assert found(spark, texts) == dict.fromkeys(range(4), (1.0, True))


ITEM = "The river that runs past the village carries 12 boats each day while Bob and his sister sell 40 baskets of red apples from the garden to the people who wait on the stone pier until evening comes again."


def test_edited_copies_are_found(spark):
    words = ITEM.split()
    half = len(words) // 2
    texts = [
        " ".join([*words[:half], "quite", *words[half:]]),  # a word inserted
        " ".join([*words[:half], *words[half + 1 :]]),  # a word dropped
        ITEM.replace("12", "1,250").replace("40", "3.5"),  # numbers of more parts
        ITEM.replace("Bob", "Mary Ann"),  # a name of more words
        ITEM.replace("12", "1,250").replace("Bob", "Mary Ann").replace("red", "bright red"),
        " ".join([*words[:half], "as we were told", *words[half : half + 9], "yes", *words[half + 9 :]]),
        "A river runs past a village and people sell apples there, 12 or 40 of them, until evening comes.",
    ]
    assert sorted(found(spark, texts, ITEM)) == [0, 1, 2, 3, 4, 5]


def test_quotations_equal_brute_force(spark):
    """Any 20 words in a row of a long item are found, wherever they start; shorter quotations of less than half are not."""
    rng = random.Random(11)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80)]
    quoted = [(a, n) for a in (0, 13, 40) for n in (12, 19, 20, 23, 30)]
    texts = ["something else stands before it " + " ".join(words[a : a + n]) + " and after it" for a, n in quoted]
    assert set(found(spark, texts, " ".join(words))) == {i for i, (_, n) in enumerate(quoted) if n >= 20}


def test_an_edited_value_takes_out_only_its_windows(spark):
    again = LONG + " After that 2019 boats came home."
    changed = again.replace("2019", "3000").replace("3000 boats", "4000 boats")
    texts = [
        LONG.replace("2019 stones", "2020 stones"),  # one of two equal numbers of a verbatim copy
        LONG.replace("2019 pears", "2020 pears"),
        LONG.replace("Carol counts", "Eve counts"),
        changed,  # two of three places of a re-parameterised number agree
    ]
    got = found(spark, texts, LONG)
    assert sorted(got) == [0, 1, 2, 3] and all(c < 1 for c, _ in (got[0], got[1])) and got[0][1] and got[1][1] and not got[3][1]
    assert 0 < found(spark, [changed], again)[0][0] < 1


# ---- near copies


def brute_classes(rows, threshold=0.8):
    sets = [frozenset(s.tolist()) for s in textvec.shingle_sets(textvec.strings(pa.array([t for _, t in rows], pa.string())))]
    parent, links = list(range(len(rows))), [0] * len(rows)

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and len(a & b) >= threshold * len(a | b):
                links[i] += 1
                links[j] += 1
                parent[root(i)] = root(j)
    members = defaultdict(list)
    for i in range(len(rows)):
        members[root(i)].append(i)
    out = []
    for m in members.values():
        least = min((rows[i][0] for i in m if rows[i][0] is not None), default=None)
        out += [(rows[i][0], least, len(m), links[i]) for i in m]
    return sorted(out, key=str)


@pytest.mark.parametrize("block", [256, 2])
def test_classes_equal_brute_force(spark, odd, odd_rows, empty, block):
    rng = random.Random(4)
    words = [f"w{i}" for i in range(90)]
    rows = [(r[0], r[1]) for r in odd_rows]
    for i in range(14):  # near copies, some of them beyond the threshold of each other
        w = list(words)
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = f"z{i}"
        rows.append((500 + i, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.classes(df, block=block).select("doc_id", "class_id", "class_size", "n_links").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute_classes(rows)
    if block == 256:
        kept = jaccard_join.keep_one(odd)
        n_classes = len({(r[1], r[2], i if r[1] is None else 0) for i, r in enumerate(brute_classes([(r[0], r[1]) for r in odd_rows]))})
        assert kept.columns == odd.columns and kept.count() >= n_classes - 1
        assert jaccard_join.classes(empty).count() == 0 and jaccard_join.keep_one(empty).count() == 0


def test_bands_reach_the_recall():
    for threshold in (0.5, 0.8, 0.95):
        b, r = jaccard_join.choose_bands(threshold, 0.999)
        assert b * r <= jaccard_join.MAX_HASHES and 1 - (1 - threshold**r) ** b >= 0.999


def test_block_links_equal_plain_sets():
    rng = np.random.default_rng(6)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(30)]
    got = jaccard_join.block_links(sets, 0.6)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            x = len(np.intersect1d(a, b))
            assert got[i, j] == (i != j and x / (len(a) + len(b) - x) >= 0.6 - 1e-12)


def test_components_of_a_chain(spark):
    pairs = [(i, f"g{i}") for i in range(12)] + [(i + 1, f"g{i}") for i in range(11)] + [(50, "x"), (51, "x")]
    got = {r["node"]: r["comp"] for r in common.components(spark.createDataFrame(pairs, "n long, g string"), "n", "g").collect()}
    assert got == {**dict.fromkeys(range(12), 0), 50: 50, 51: 50}
