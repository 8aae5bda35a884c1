import hashlib
import math
import re
import textwrap
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from octoweave.llm import ann, common, dartminhash, decontaminate, licenses, line_dedup, mixing, passages, quality, suffix_dedup, toxicity

DOCS = "doc_id long, text string"


def words(text):
    return re.findall(rb"[0-9a-z\x80-\xff]+", (text or "").encode().translate(bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))))


@pytest.fixture(scope="module")
def sample(spark, sf_dir):
    """Documents of the smallest table, with awkward rows."""
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(9000, None), (9001, ""), (9002, "\n\n \n"), (9003, "ab " * 3000), (9004, rows[3][1] * 3), (None, rows[5][1]), (None, None), (rows[0][0], rows[0][1]), (9005, "One two"), (9006, "one  TWO.")]
    return rows


def frame(spark, rows):
    """With columns whose names clash with what the operators use."""
    df = spark.createDataFrame(rows, DOCS)
    for name in ("block", "bucket", "size", "class_id", "id_", "k_", "row_", "held_out", "score", "key", "target"):
        df = df.withColumn(name, F.lit("x"))
    return df


def roots(nodes, pairs):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


# --- 1


def test_nearest_finds_the_true_neighbours(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    got = ann.nearest(df).toPandas()
    pdf = df.toPandas().sort_values("vec_id")
    x, ids = np.stack(pdf["embedding"]).astype(float), pdf["vec_id"].to_numpy()
    hit = total = 0
    for q, rows in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        best = [int(i) for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        assert rows.sort_values("rank")["rank"].tolist() == list(range(1, 21)) and (np.diff(rows.sort_values("rank")["score"]) <= 0).all()
        hit += len(set(best) & set(rows["vec_id"]))
        total += 20
        assert np.allclose(rows.set_index("vec_id")["score"], [x[ids == v][0] @ x[ids == q][0] for v in rows["vec_id"]])
    assert set(got["query_id"]) == {int(i) for i in ids if i % 20 == 0} and hit / total >= 0.9


def test_nearest_breaks_ties_and_leaves_bad_vectors_out(spark):
    rows = [(i, [1.0, 2.0]) for i in range(0, 100)] + [(200, None), (201, [0.0, 0.0]), (202, [float("nan"), 1.0]), (203, [None, 1.0]), (204, [float("inf"), 1.0]), (205, [1.0]), (None, [1.0, 2.0]), (40, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("block", F.lit(1)).withColumn("rank", F.lit(1))
    got = defaultdict(list)
    for r in ann.nearest(df).orderBy("rank").collect():
        got[r["query_id"]].append(r["vec_id"])
    assert got == {q: [i for i in range(100) if i != q][:20] for q in range(0, 100, 20)}
    few = ann.nearest(spark.createDataFrame([(0, [1.0]), (1, [2.0]), (2, [0.5])], "vec_id long, embedding array<float>")).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in few] == [(1, 2.0), (2, 0.5)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_far_queries_still_get_all_their_neighbours(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARE", 0.0)
    rng = np.random.default_rng(3)
    rows = [(i, (rng.normal(size=8) + 5 * (i % 2)).tolist()) for i in range(300)] + [(1000, [-50.0] * 8)]
    got = Counter(r["query_id"] for r in ann.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect())
    assert got == {q: 20 for q in [*range(0, 300, 20), 1000]}


def test_probing_finds_every_code_within_the_radius():
    rng = np.random.default_rng(0)
    codes = rng.integers(0, 256, (500, 8)).astype(np.uint8)
    for radius in (0, 5, 17, 28, 64):
        want = ann.hamming(codes[:20, None], codes[None]) <= radius
        assert np.array_equal(ann.Block(codes).within(codes[:20], radius), want)


# --- 2


def test_line_windows_agree_with_brute_force(spark, sample):
    seen, covered = {}, defaultdict(set)
    order = sorted({(i is None, i or 0, t or "") for i, t in sample if i is not None})
    for _, i, t in order:
        lines = [(n, x.strip(" ")) for n, x in enumerate(t.split("\n")) if x.strip(" ")]
        for p in range(len(lines) - 2):
            w = tuple(x for _, x in lines[p : p + 3])
            if w in seen:
                covered[i].update(n for n, _ in lines[p : p + 3])
            seen.setdefault(w, (i, p))
    df = frame(spark, [r for r in sample if r[0] is not None])
    out = line_dedup.line_dedup(df)
    assert out.columns == [*df.columns, "n_lines_", "n_removed_"]
    texts = dict(sample)
    for r in out.collect():
        t = texts[r["doc_id"]]
        assert r["n_removed_"] == len(covered[r["doc_id"]])
        assert r["text"] == (None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in covered[r["doc_id"]]))
    assert out.count() == len([r for r in sample if r[0] is not None]) and line_dedup.line_dedup(df.limit(0)).count() == 0


def test_null_ids_come_last_and_equal_rows_fare_alike(spark):
    text = "a\nb\nc\nd"
    out = line_dedup.line_dedup(spark.createDataFrame([(None, text), (7, text), (7, text), (3, "x\na\nb\nc")], DOCS)).collect()
    assert sorted((str(r["doc_id"]), r["text"]) for r in out) == [("3", "x\na\nb\nc"), ("7", "d"), ("7", "d"), ("None", "")]


# --- 3


def test_passages_link_the_documents_that_share_them(spark):
    rng = np.random.default_rng(8)
    text = lambda n: " ".join("w%d" % v for v in rng.integers(0, 10**6, n))
    shared, other = text(60), text(60)
    edited = shared.split()
    edited[30] = "changed"
    rows = [(1, text(200) + " " + shared + " " + text(90)), (2, shared.upper().replace(" ", ", ") + " " + text(300)), (3, text(100)), (4, text(70) + " " + " ".join(edited)), (5, other), (6, text(49) + " " + " ".join(other.split()[:40])), (7, text(400)), (8, rows_ := text(120)), (9, rows_), (10, None), (11, ""), (None, shared), (12, text(30))]
    got = {r["doc_id"]: r for r in passages.passage_dedup(frame(spark, rows)).collect()}
    assert {k: v["class_id"] for k, v in got.items()} == {1: 1, 2: 1, 3: 3, 4: 1, 5: 5, 6: 6, 7: 7, 8: 8, 9: 8, 10: 10, 11: 11, None: None, 12: 12}
    assert (got[1]["first_word"], got[1]["last_word"]) == (200, 259) and got[3]["n_links"] == 0 and got[3]["first_word"] is None
    assert passages.passage_dedup(frame(spark, rows).limit(0)).count() == 0


def test_no_exact_passage_is_missed(spark, sample):
    rows = [(i, t) for i, t in {(i, t) for i, t in sample if i is not None and i != 9004}]
    first, pairs = {}, set()
    for i, t in sorted(rows, key=str):
        w = words(t)
        for p in range(len(w) - 49):
            h = tuple(w[p : p + 50])
            if first.setdefault(h, i) != i:
                pairs.add((first[h], i))
    got = {r["doc_id"]: r["class_id"] for r in passages.passage_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert pairs and all(got[a] == got[b] for a, b in pairs)


def test_passages_are_found_whatever_earlier_documents_hold_of_them(spark):
    """Halves of a passage stand in the first documents, or its lines in many, so that no group's first document holds it whole."""
    rng = np.random.default_rng(11)
    word = lambda n: " ".join(f"w{i}" for i in rng.integers(0, 1 << 40, n))
    rows, shared = [], []
    for g in range(20):
        passage = word(60).split()
        halves = [" ".join(passage[:30]), " ".join(passage[30:])]
        rows += [(100 * g + i, f"{word(40)} {halves[i % 2]} {word(40)}") for i in range(4)]
        rows += [(100 * g + 50 + i, f"{word(40)} {' '.join(passage)} {word(40)}") for i in range(3)]
        shared.append([100 * g + 50 + i for i in range(3)])
    for partitions in (1, 40):
        frame_ = spark.createDataFrame(rows, DOCS).repartition(partitions)
        got = {r["doc_id"]: r["class_id"] for r in passages.passage_dedup(frame_).collect()}
        assert all(got[d] == ids[0] for ids in shared for d in ids)
        assert all(got[100 * g + i] == 100 * g + i for g in range(20) for i in range(4))


def test_no_link_of_a_chain_of_edits_is_lost(spark):
    """The second text is like the first, the third like the second alone: one region of a name is settled, the other is not."""
    rng = np.random.default_rng(21)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    rows, chains = [], 60
    for g in range(chains):
        a = word(50)
        b, c = list(a), list(a)
        b[2] = c[2] = word(1)[0]
        c[47] = word(1)[0]
        rows += [(10 * g + i, " ".join(word(60) + t + word(60))) for i, t in enumerate((a, b, c))]
    for partitions in (1, 30):
        got = {r["doc_id"]: r["class_id"] for r in passages.passage_dedup(spark.createDataFrame(rows, DOCS).repartition(partitions)).collect()}
        second, third = (sum(got[10 * g + i] == got[10 * g + j] for g in range(chains)) for i, j in ((0, 1), (1, 2)))
        assert second >= 0.9 * chains and third >= 0.9 * chains, (second, third)


def test_a_passage_is_found_beside_many_documents_that_hold_one_shingle_of_it(spark):
    rng = np.random.default_rng(5)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    passage = word(55)
    rows = [(i, " ".join(word(30) + passage[(p := i % 51) : p + 5] + word(30))) for i in range(3060)]
    rows += [(d, " ".join(word(40) + passage + word(40))) for d in (5000, 5001)]
    got = {r["doc_id"]: r["class_id"] for r in passages.passage_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert got[5001] == 5000 and all(got[i] == i for i in range(3060))


def test_recall_of_edited_passages_and_unlike_ones_left_alone(spark):
    """Windows of 60 words with four words changed, pairs by pair; the truth is the best similarity of any two windows of WINDOW shingles."""
    rng = np.random.default_rng(9)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    rows, near, far = [], [], []
    for g in range(150):
        p = word(60)
        q = list(p)
        for at in rng.choice(60, int(rng.integers(1, 5)), replace=False):
            q[at : at + 1] = word(int(rng.integers(0, 3)))
        one, two = word(50) + p + word(50), word(30) + q + word(70)
        sides = [[tuple(t[i : i + 5]) for i in range(len(t) - 4)] for t in (one, two)]
        windows = [[set(t[i : i + 46]) for i in range(0, len(t) - 45)] for t in sides]
        shared = max((len(a & b) for a in windows[0] for b in windows[1] if a & b), default=0)
        (near if shared / (92 - shared) >= 0.8 else far).append(g)
        rows += [(2 * g, " ".join(one)), (2 * g + 1, " ".join(two))]
    got = {r["doc_id"]: r["class_id"] for r in passages.passage_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    found = sum(got[2 * g + 1] == 2 * g for g in near)
    assert len(near) > 20 and len(far) > 20 and found >= 0.9 * len(near) and all(got[2 * g + 1] == 2 * g + 1 for g in far)


def regions_table(rows):
    """(name, node, class_id, c, lo, shingles) as the second round gets them."""
    rows = [(0, name, 0, 0, 0, node, class_id, c, lo, dartminhash.K.pack_ints(np.array(v, np.uint64), passages.HASH_BYTES)) for name, node, class_id, c, lo, v in rows]
    names = ("bucket", "name", "p", "q", "at", "node", "class_id", "c", "lo", "shingles")
    return pa.table({n: pa.array([r[i] for r in rows], pa.binary() if n == "shingles" else pa.int64()) for i, n in enumerate(names)})


def test_regions_of_a_name_meet_as_if_all_were_compared():
    """Edits, drifts and periodic texts against a loop over all pairs, in order."""
    rng = np.random.default_rng(31)
    hits = 0
    for turn in range(40):
        rows, letters = [], int(rng.choice([3, 1 << 39]))
        for name in range(int(rng.integers(1, 4))):
            base = rng.integers(1, letters + 1, 91)
            for _ in range(int(rng.integers(2, 40))):
                v = list(base)
                v[45] = (1 << 39) + name
                for at in sorted(rng.choice(np.r_[:45, 46:91], int(rng.choice([0, 3, 6, 12, 40])), replace=False).tolist(), reverse=True):
                    v[at : at + 1] = rng.integers(4, 1 << 39, int(rng.choice([1, 1, 1, 0, 2]) if 20 < at < 70 and turn % 2 else 1)).tolist()
                centre = v.index((1 << 39) + name)
                a, b = sorted(rng.integers(0, 46, 2).tolist(), reverse=True)
                a, b = min(a, centre), max(b, centre + 46 - len(v))
                if a >= b >= 0:
                    rows.append((name, len(rows), int(rng.integers(0, 30)), 500, 500 - a, v[centre - a : centre - b + 46]))
        if not rows:
            continue
        rows.sort(key=lambda r: (r[0], r[2], r[1]))
        width, centre = passages._WIDTH, passages._CENTRE
        held, a, of = np.zeros((len(rows), width), bool), np.zeros((len(rows), width), np.uint64), [r[2] for r in rows]
        for i, (_, _, _, c, lo, v) in enumerate(rows):
            at = centre - c + lo
            held[i, at : at + len(v)], a[i, at : at + len(v)] = True, v
        want = []
        for i in range(len(rows)):
            for j in range(i):
                if rows[i][0] == rows[j][0] and rows[i][2] != rows[j][2] and of[i] != of[j] and passages._side_by_side(a, held, np.array([i]), np.array([j]))[0]:
                    want.append((rows[i][1], rows[j][1]))
                    of = [min(of[i], of[j]) if x == max(of[i], of[j]) else x for x in of]
        got = passages._joins(regions_table([rows[i] for i in rng.permutation(len(rows))]))
        assert list(zip(got["x"].to_pylist(), got["z"].to_pylist())) == want
        hits += len(want)
    assert hits > 100


def test_unlike_regions_of_a_name_do_not_all_meet(monkeypatch):
    """Regions that share a line about their centre, and two that are alike."""
    rng, n, met = np.random.default_rng(32), 1500, []
    base = rng.integers(1, 1 << 39, 60)
    rows = []
    for i in range(n):
        v = rng.integers(1, 1 << 39, 60)
        v[18:38] = base[18:38]
        rows.append((5, i, i, 100, 70, v if i != n - 1 else np.r_[rows[7][5][:50], v[50:]]))
    likely = passages._likely
    monkeypatch.setattr(passages, "_likely", lambda a, held, x, z: met.append(len(x)) or likely(a, held, x, z))
    got = passages._joins(regions_table(rows))
    assert list(zip(got["x"].to_pylist(), got["z"].to_pylist())) == [(n - 1, 7)] and sum(met) <= 10 * n


def test_what_the_first_links_connect_is_not_compared_again(spark, monkeypatch):
    """Many share one passage, and by others are linked to different documents first: all are one group before the second round."""
    rng = np.random.default_rng(33)
    word = lambda n: [f"w{i}" for i in rng.integers(0, 1 << 40, n)]
    passage, others = word(60), [word(60) for _ in range(10)]
    rows = [(i, " ".join(word(60) + passage + word(60) + others[i % 10] + word(60))) for i in range(60)]

    def refuse(regions):
        raise ValueError(f"{len(regions)} regions are compared again")

    monkeypatch.setattr(passages, "_joins", refuse)
    got = {r["doc_id"]: r["class_id"] for r in passages.passage_dedup(spark.createDataFrame(rows, DOCS)).collect()}
    assert set(got.values()) == {0}


def test_texts_that_share_a_doc_id_are_each_compared(spark):
    rng = np.random.default_rng(2)
    text = lambda n: " ".join("w%d" % v for v in rng.integers(0, 10**6, n))
    one, two = text(60), text(60)
    rows = [(1, one), (1, text(300) + " " + two), (2, text(9) + " " + one), (3, two + " " + text(9)), (3, two + " " + text(9)), (4, text(80))]
    assert {r["doc_id"]: r["class_id"] for r in passages.passage_dedup(spark.createDataFrame(rows, DOCS)).collect()} == {1: 1, 2: 1, 3: 1, 4: 4}


def test_compact_windows_are_the_wide_ranges_of_the_tree():
    rng = np.random.default_rng(1)
    shingles = rng.integers(0, 2**63, 400).astype(np.uint64)
    to = np.array([0, 150, 150, 400])
    key, doc, l, c, r = passages.compact_windows(shingles, to, 2)
    h = dartminhash.K.mix64(shingles ^ np.uint64(0x9E3779B97F4A7C15 * 3 % 2**64)) & np.uint64(0xFFFFFFFFFF000000)
    want = set()

    def grow(d, base, lo, hi):
        if hi - lo + 1 >= passages.WINDOW:
            m = lo + int(np.argmin(h[lo : hi + 1]))
            want.add((d, lo - base, m - base, hi - base))
            grow(d, base, lo, m - 1)
            grow(d, base, m + 1, hi)

    grow(0, 0, 0, 149)
    grow(2, 150, 150, 399)
    assert {tuple(map(int, x)) for x in zip(doc, l, c, r)} == want


# --- 4


def mixed(spark, rows, **kw):
    return mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("target", F.lit(1)).withColumn("taken", F.lit(1)), **kw)


def test_mix_keeps_to_its_contract(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("source", F.when(F.col("doc_id") % 9 != 0, F.col("source")))
    got = mixing.mix(docs).toPandas()
    per = got.groupby(got["source_size"].astype(str) + "|" + got["target"].astype(str))
    for _, g in per:
        assert g["size"].sum() == g["source_size"].iloc[0]
        assert abs(g["taken"].sum() - g["target"].iloc[0]) <= max(mixing.BLOCK, 0.02 * g["target"].iloc[0])
    assert (got["taken"] <= 3 * got["size"]).all() and (got["taken"] >= 0).all()
    assert abs(sum(g["target"].iloc[0] for _, g in per) - got["size"].sum()) < 1e-3 * got["size"].sum()
    again = mixing.mix(docs.repartition(7)).toPandas()
    assert got.sort_values("doc_id").reset_index(drop=True).equals(again.sort_values("doc_id").reset_index(drop=True))


def test_mix_takes_awkward_rows(spark):
    rows = [(1, None, "b"), (2, "", None), (3, "one two\x0bthree four five", "a"), (3, "one two\x0bthree four five", "a"), (None, "x " * 500, "Z"), (4, "y " * 10, None)]
    got = mixed(spark, rows).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter([(1, 0), (2, 0), (3, 4), (3, 4), (None, 500), (4, 10)])
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert mixed(spark, rows[:0] or [(1, None, None)]).first()["taken"] == 0
    assert mixing.mix(spark.createDataFrame([], "doc_id long, text string, source string")).count() == 0
    carried = mixed(spark, rows, carry=True)
    assert set(carried.columns) == {"doc_id", "size", "source_size", "target", "taken", "text", "source"}


@pytest.mark.parametrize("seed", range(6))
def test_seats_go_to_the_highest_quotients(seed):
    rng = np.random.default_rng(seed)
    votes, seats = (rng.pareto(0.7, rng.integers(1, 30)) * 1000).tolist(), int(rng.integers(1, 500))
    want = [0] * len(votes)
    for _ in range(seats):
        want[max(range(len(votes)), key=lambda i: (votes[i] / (2 * want[i] + 1), -i))] += 1
    assert mixing.sainte_lague(votes, seats) == want


def test_targets_fill_like_water():
    assert mixing.targets([10, 1000, 1000], [5.0, 2.0, 1.0], 2010) == pytest.approx([30, 1320, 660])
    assert mixing.targets([0, 0], [5.0, 2.0], 0) == [0, 0]


# --- 5

BENCH = [(1, "Alice bought 3 apples for 12 dollars and then 3 more apples from the market near her house"), (2, "The river runs past seven mills before it reaches the quiet sea at dawn"), (3, "too short"), (4, None), (None, "no id has this item at all")]


def test_leaks_with_other_slots_are_caught_and_shuffled_ones_are_not(spark):
    bench = spark.createDataFrame(BENCH, "item_id long, text string").withColumn("doc_id", F.lit(5))
    rows = [
        (1, "Well. " + BENCH[0][1] + " indeed."), (2, "so Robert bought 8 apples for 40 euros and then 8 more apples from the market near her house ok"),
        (3, "Robert bought 8 apples for 40 euros and then 9 more apples from the market near her house"), (4, "the river runs past eight mills before it reaches the quiet sea at dawn"),
        (5, "the river runs past seven"), (6, None), (7, ""), (None, BENCH[1][1]), (8, "nothing here"), (1, "Well. " + BENCH[0][1] + " indeed."), (9, "THE RIVER RUNS PAST"), (10, BENCH[1][1].upper()), (11, BENCH[1][1].lower()),
    ]
    got = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(frame(spark, rows), bench).collect())
    assert got[(1, 1)] == 2 and (2, 1) in got and (3, 1) not in got and got[(None, 2)] == 1 and (5, 2) not in got
    assert (10, 2) in got and (11, 2) in got
    assert set(got) <= {(1, 1), (2, 1), (4, 2), (None, 2), (10, 2), (11, 2)}
    kept = decontaminate.clean(frame(spark, rows), bench)
    assert kept.columns == frame(spark, rows).columns
    assert {r["doc_id"] for r in kept.collect()} == {r[0] for r in rows} - {k[0] for k in got}
    assert decontaminate.leaks(frame(spark, rows).limit(0), bench).count() == 0 and decontaminate.leaks(frame(spark, rows), bench.limit(0)).count() == 0


def test_leaks_with_longer_values_or_added_words_are_caught(spark):
    item = "when did the old teacher give her friend Maria about as many bright glass marbles as 25 of the smaller children had"
    longer = item.replace("Maria", "Ana Lopez").replace("25", "twenty five")
    added = item.replace("teacher give", "teacher so kindly give").replace("bright glass", "bright and shining glass")
    rows = [(1, item), (2, f"Well, {longer} and so on"), (3, f"it says {added}"), (4, "when did the old teacher go home and not give her friend anything of the smaller kind")]
    found = decontaminate.leaks(frame(spark, rows), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()
    assert sorted(r["doc_id"] for r in found) == [1, 2, 3]
    assert {r["doc_id"]: r["first_token"] for r in found} == {1: 0, 2: 1, 3: 2}


def test_verbatim_copies_of_items_short_of_plain_words_are_caught(spark):
    items = ["Convert 12 km, 7 m and 3 cm", "Anna Berta Carla Dora Emil Frida Gustav Hans", "Die Katze Jagt Den Hund Durch Das Haus", "two plus two"]
    rows = [(i, f"so then: {text}. That is all") for i, text in enumerate(items)] + [(10, "Convert 14 km, 9 m and 8 kg"), (11, "two plus"), (12, "Anna Berta Otto Dora Karl Frida Max Hans")]
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    found = {(r["doc_id"], r["item_id"], r["coverage"], r["first_token"]) for r in decontaminate.leaks(frame(spark, rows), bench).collect()}
    assert found == {(i, i, 1.0, 2) for i in range(4)}


def test_a_large_benchmark_is_searched_in_parts(spark, sf_dir, monkeypatch):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    whole = Counter((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect())
    monkeypatch.setattr(decontaminate, "PART_BYTES", 2000)
    assert whole == Counter((r["doc_id"], r["item_id"]) for r in decontaminate.leaks(docs, bench).collect())
    texts, items = dict(docs.select("doc_id", "text").collect()), dict(bench.select("item_id", "text").collect())
    assert {(d, i) for d, t in texts.items() for i, b in items.items() if b in t} == set(whole)


# --- 6


@pytest.mark.parametrize("hot", [suffix_dedup.HOT, 8, 0])
def test_suffixes_agree_with_brute_force(spark, sample, monkeypatch, hot):
    monkeypatch.setattr(suffix_dedup, "BLOCK_BYTES", 60_000)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", 60_000)
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    rows, first = [*sample, *((9100 + i, f"{i // 3:030d} the quarterly report of the {i % 7:030d}") for i in range(60))], {}
    id_ = lambda i: 2**63 - 1 if i is None else i
    for i, t in rows:
        b = (t or "").encode()
        for p in range(len(b) - 49):
            first[b[p : p + 50]] = min(first.get(b[p : p + 50], 2**63), id_(i))
    want = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            gone[p : p + 50] |= first[b[p : p + 50]] < id_(i)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        want.append((i, len(b), int(gone.sum()), int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest(), kept))
    got = [(r["doc_id"], r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"], bytes(r["kept"])) for r in suffix_dedup.suffix_dedup(frame(spark, rows)).collect()]
    assert Counter(got) == Counter(want)
    assert suffix_dedup.suffix_dedup(frame(spark, rows).limit(0), texts=False).count() == 0


# --- 7


def test_licenses_agree_with_brute_force(spark, sample):
    rows = sample + [(9100, "x\nReleased, under the MIT license! Under the mit LICENSE\ncc by nc\nCC BY-NC cc by nc"), (9101, "This WORK is licensed under the GNU general public license (version 3)."), (9102, "under the KIT license under\nthe mit license"), (9103, "unde r the mit license"), (9104, "mit under license"), *[(9110 + i, "\n".join("// " + x for x in textwrap.wrap(text.capitalize() + ".", 60))) for i, (_, text) in enumerate(licenses.TEMPLATES)],
             (9200, "intro " * 37 + licenses.TEMPLATES[2][1]), (9201, " ".join(w + " filler" * 40 for w in licenses.TEMPLATES[1][1].split()))]
    got = Counter(tuple(r) for r in licenses.scan(frame(spark, rows)).collect())
    want = Counter()
    for i, t in rows:
        w = [x.decode() for x in words(t)]
        places = [(p, label) for phrase, label in licenses.PHRASES.items() for p in range(len(w)) if w[p : p + len(phrase.split())] == phrase.split()]
        met = {}
        for _, label, need_words, need, width in licenses.template_sets():
            for j in range(0, len(w), width):
                have = set(w[j : j + 2 * width])
                if len(have & set(need_words)) >= need:
                    met[label] = max(met.get(label, 0), len(have & set(need_words)) / len(need_words))
        base = sorted({label for _, label in places})
        at = [p for p, _ in places]
        want[(i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(base), ",".join(sorted({*base, *met})), 1.0 if at else max(met.values(), default=0.0))] += 1
    assert got == want
    labels = {k[0]: k[6].split(",") for k in got}
    assert all(label in labels[9110 + i] for i, (label, _) in enumerate(licenses.TEMPLATES)) and "mit" in labels[9200] and labels[9201] == [""]
    assert licenses.scan(frame(spark, rows).limit(0)).count() == 0


# --- 8 and 10


def labelled(spark, n=400):
    rng = np.random.default_rng(5)
    vocabulary = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        w = list(rng.choice(vocabulary, int(rng.integers(10, 200))))
        bad, junk = i % 4 == 0, i % 5 == 0
        if bad:
            for _ in range(3):
                w.insert(int(rng.integers(0, len(w))), rng.choice(["vile", "horrid", "nasty"]))
        rows.append((i, " ".join(x + "%%##" if junk else x for x in w)))
        labels.append((i, int(not junk), int(bad)))
    return rows, labels


@pytest.mark.parametrize("module, run, label", [(quality, quality.quality, "quality"), (toxicity, toxicity.toxicity, "toxic")])
def test_models_learn_from_rows_that_are_not_held_out(spark, module, run, label):
    import zlib

    rows, labels = labelled(spark)
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, None, None), (10**6, 1, 1)], "doc_id long, quality int, toxic int")
    odd = [(5000, None), (5001, ""), (5002, "!?"), (5003, "long " * 50_000), (None, "nothing"), rows[0]]
    df = frame(spark, rows + odd)
    out = run(df, lab).collect()
    assert len(out) == len(rows) + len(odd) and all(0 <= r["score"] <= 1 for r in out)
    assert all(r["predicted"] == int(r["score"] >= module.THRESHOLD) for r in out)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in out)
    truth = {d: (q if label == "quality" else t) for d, q, t in labels}
    held = [(r["score"], truth[r["doc_id"]]) for r in out if r["held_out"] and r["doc_id"] in truth]
    ones, zeros = [s for s, y in held if y], [s for s, y in held if not y]
    assert np.mean([a > b for a in ones for b in zeros]) > 0.9
    # What held-out rows are labelled changes nothing.
    flipped = lab.withColumn(label, F.when(common.held_out(), 1 - F.col(label)).otherwise(F.col(label)))
    if module is quality:
        assert sorted((str(r["doc_id"]), r["score"]) for r in run(df, flipped).collect()) == sorted((str(r["doc_id"]), r["score"]) for r in out)


def test_labels_of_other_documents_take_no_place_in_the_sample(spark):
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)] + [(5, "again"), (6, None), (7, "long " * 99)], DOCS)
    labels = spark.range(20_200).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("toxic"))
    fit = lambda rows: {r["doc_id"]: r["text"] for r in common.labelled_sample(docs, labels, "toxic", rows, 100).collect()}
    free = {r["id"] for r in spark.range(200).where(~common.held_out("id")).collect()}
    assert set(fit(1000)) == free and len(fit(100)) == 100 and set(fit(100)) < free and fit(1000).get(5, "again") == "again"


@pytest.mark.parametrize("run", [quality.quality, toxicity.toxicity])
def test_models_without_labels_or_rows(spark, run):
    df, none = frame(spark, [(1, "a b c"), (2, None)]), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in run(df, none).collect()] == [0.5, 0.5]
    assert run(df.limit(0), none).count() == 0


def test_gradients_are_those_of_the_loss():
    import pyarrow as pa

    data, off = toxicity.K.text_buffer(pa.array(["alpha beta gamma delta", "beta beta vile words here and there " * 6]))
    w = toxicity.Words(data, off)
    net = toxicity.Network(np.unique(w.hash), np.zeros(len(np.unique(w.hash)) + 1), 0.5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    windows, y = np.arange(len(w.first)), np.array([1.0, 0.0, 1.0])[: len(w.first)]

    def loss():
        row, x = net.inputs(w)
        logit = net.forward(net.projected(x), *w.places(windows))
        return float((np.logaddexp(0, logit) - y * logit).mean())

    got = net.gradients(w, *net.inputs(w), *w.places(windows), y)
    rng = np.random.default_rng(0)
    for name in ("wx", "wh", "wa", "va", "wo", "bo", "b"):
        flat = net.p[name].reshape(-1)
        for i in rng.integers(0, flat.size, 3):
            old, e = flat[i], 1e-2
            flat[i] = old + e
            up = loss()
            flat[i] = old - e
            down = loss()
            flat[i] = old
            assert got[name].reshape(-1)[i] == pytest.approx((up - down) / (2 * e), abs=2e-3)


def test_scores_are_those_of_a_plain_network():
    """Window by window, word by word, in plain Python floats."""
    import pyarrow as pa

    texts = ["alpha beta gamma delta " * 20, "Vile words, here and there. " * 9, "one", "", "caf\u00e9 " * 33]
    data, off = toxicity.K.text_buffer(pa.array(texts))
    w = toxicity.Words(data, off)
    vocabulary = np.unique(w.hash)[::2]
    rng = np.random.default_rng(4)
    net = toxicity.Network(vocabulary, rng.normal(0, 1, len(vocabulary) + 1), 0.5)
    net.p["b"], net.p["bo"] = rng.normal(0, 0.2, net.p["b"].shape), np.array([0.3])
    net.calibration, net.fitted = np.array([1.5, -0.2, 0.1]), True
    p, h, squash = net.p, toxicity.HIDDEN, lambda v: v / (1 + abs(v))

    def word(name, text):
        hit = np.flatnonzero(vocabulary == name)
        row = int(hit[0]) if len(hit) else len(vocabulary)
        codes = [c + 32 if 65 <= c <= 90 else c for c in text] + [0, 0]
        grams = [((codes[i] * 961 + codes[i + 1] * 31 + codes[i + 2]) * 2654435761 % 2**32) >> 20 for i in range(max(len(text) - 2, 1))]
        return [float(net.odds[row]), *p["word"][row], *np.mean([p["char"][g] for g in grams], axis=0)]

    def logit(inputs):
        states = [[0.0] * (2 * h) for _ in inputs]
        for d in (0, 1):
            old = np.zeros(h)
            for t in range(len(inputs)) if d == 0 else reversed(range(len(inputs))):
                g, r = np.array(inputs[t]) @ p["wx"][d] + p["b"][d], old @ p["wh"][d]
                new = np.zeros(h)
                for k in range(h):
                    z, reset = (0.5 + 0.5 * squash(g[k + m] + r[k + m]) for m in (0, h))
                    new[k] = z * old[k] + (1 - z) * squash(g[k + 2 * h] + reset * r[k + 2 * h])
                states[t][d * h : (d + 1) * h] = old = new
        weigh = [math.exp(sum(v * squash(x) for v, x in zip(p["va"], np.array(s) @ p["wa"]))) for s in states]
        pooled = sum(a * np.array(s) for a, s in zip(weigh, states)) / sum(weigh)
        return float(pooled @ p["wo"] + p["bo"][0])

    want, at = [], 0
    for text in texts:
        # A word of under three bytes reads on into what follows it; here no word is so short.
        found = re.findall(rb"[0-9A-Za-z\x80-\xff]+", text.encode())
        inputs = [word(w.hash[at + i], x) for i, x in enumerate(found)]
        at += len(found)
        windows = [inputs[a : a + toxicity.WINDOW] for a in range(0, max(len(inputs) - toxicity.WINDOW, 0) + toxicity.STRIDE, toxicity.STRIDE) if inputs]
        windows = windows[: 1 + max(0, -(-(len(inputs) - toxicity.WINDOW) // toxicity.STRIDE))] if inputs else []
        best = max((logit(x) for x in windows), default=float(p["bo"][0]))
        a, b, c = net.calibration
        want.append(1 / (1 + math.exp(-(a * best + b * math.log1p(len(windows)) + c))))
    assert net.score(w) == pytest.approx(want, abs=2e-5)


def test_statistics_and_trees_are_those_of_plain_loops(sample):
    import pyarrow as pa

    texts = [t for _, t in sample if t is None or len(t) < 20_000][-60:] + ["AB ab AB! x?", "word " * 40, "\u00e9\u00e9 \n# {1}", "y" * 30]
    data, off = quality.K.text_buffer(pa.array(texts))
    got, want = quality.statistics(data, off), []
    for text in texts:
        raw = (text or "").encode()
        n, seen = max(len(raw), 1), Counter(raw)
        found = [m.group() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", raw)]
        folded, many = Counter(words(text)), max(len(found), 1)
        plain = words(text)
        share = lambda members: sum(seen[c] for c in members) / n
        mean = sum(map(len, found)) / many
        spread = max(sum(len(x) ** 2 for x in found) / many - mean**2, 0)
        lines = seen[10]
        want.append([
            math.log1p(len(raw)), math.log1p(len(found)), *(share(m) for m in quality._CLASSES.values()), share(range(128, 256)), -sum(v / n * math.log2(v / n) for v in seen.values()),
            max(seen.values(), default=0) / n, mean, math.sqrt(spread), len(folded) / many, max(folded.values(), default=0) / many,
            sum(a == b for a, b in zip(plain, plain[1:])) / many, sum(65 <= x[0] <= 90 for x in found) / many, sum(len(x) > 20 for x in found) / many, len(found) / (lines + 1), math.log1p(lines),
        ])
    assert got.shape == (len(texts), 21) and np.allclose(got, want, atol=1e-6)
    rng = np.random.default_rng(1)
    x = np.r_[got, rng.random((300, 21)) * got.max(axis=0)]
    forest = quality.Forest(x, (x[:, 0] + x[:, 12] > np.median(x[:, 0] + x[:, 12])).astype(float))

    def walk(row):
        total = forest.bias
        for feature, threshold, value in zip(forest.feature, forest.threshold, forest.value):
            node = 0
            for _ in range(quality.DEPTH):
                node = 2 * node + (2 if row[feature[node]] > threshold[node] else 1)
            total += value[node - len(feature)]
        return 1 / (1 + math.exp(-total))

    assert forest.score(x) == pytest.approx([walk(row) for row in x])


def test_trees_fit_what_one_split_cannot():
    rng = np.random.default_rng(0)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    forest = quality.Forest(x[:1500], y[:1500])
    assert ((forest.score(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95


def test_words_of_long_texts_are_those_of_their_pieces(monkeypatch):
    import pyarrow as pa

    K = toxicity.K
    rng = np.random.default_rng(3)
    texts = [" ".join("x" * int(n) for n in rng.integers(1, 9, 400)), "", "y" * 500, "\u00e9t\u00e9 " * 60, None, "end", "z" * 129 + " z", "a"]
    data, off = K.text_buffer(pa.array(texts))
    whole = [*K.word_spans(data, off), K.words_of(data, off)[0]]
    plain = [m.span() for i, j in zip(off, off[1:]) for m in [*re.finditer(rb"[0-9A-Za-z\x80-\xff]+", data[i:j].tobytes())]]
    assert [b - a for a, b in plain] == (whole[1] - whole[0]).tolist()
    for piece in (16, 64, 100, 1000):
        monkeypatch.setattr(K, "PIECE_BYTES", piece)
        assert all(np.array_equal(x, y) for x, y in zip(whole, [*K.word_spans(data, off), K.words_of(data, off)[0]]))


# --- 9


def shingles(text):
    w = words(text)
    return Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4)) or (Counter([tuple(w)]) if w else Counter())


def alike(a, b):
    """Weighted Jaccard similarity of two counters, each shingle weighing log2(1 + n)."""
    weigh = lambda c: sum(math.log2(1 + n) for n in c.values())
    common = weigh(a & b)
    return common / (weigh(a) + weigh(b) - common)


def test_near_duplicates_agree_with_brute_force(spark, sample):
    rng = np.random.default_rng(4)
    base = [f"t{v}" for v in rng.integers(0, 10**6, 300)]
    rows = list(sample)
    for i in range(40):
        w = list(base)
        for p in rng.integers(0, 300, i % 9):
            w[p] = "edit%d" % rng.integers(0, 10**6)
        rows.append((7000 + i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows if i is not None}
    ids = sorted(sets)
    pairs = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if sets[a] and sets[b] and alike(sets[a], sets[b]) >= 0.8 - 1e-9]
    want = roots(ids, pairs) | {None: None}
    got = dartminhash.near_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows) and {r["doc_id"]: r["class_id"] for r in got} == want
    assert dartminhash.near_dedup(frame(spark, rows).limit(0)).count() == 0


def test_large_buckets_compared_in_blocks_lose_no_link(spark, monkeypatch):
    monkeypatch.setattr(dartminhash, "PAIRED", 2)
    monkeypatch.setattr(dartminhash, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(6)
    base, rows = [f"t{v}" for v in rng.integers(0, 10**6, 200)], []
    for i in range(60):
        w = list(base)
        for p in rng.integers(0, 200, 6):
            w[p] = "e%d" % rng.integers(0, 10**6)
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    pairs = [(a, b) for a in sets for b in sets if a < b and alike(sets[a], sets[b]) >= 0.8 - 1e-9]
    want = roots(sets, pairs)
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.near_dedup(spark.createDataFrame(rows, DOCS)).collect()} == want
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.near_dedup(spark.createDataFrame(rows, DOCS), agree=0).collect()} == want
    # A second, unlike text under each doc_id splits no class.
    more = rows + [(i, " ".join(f"u{v}" for v in rng.integers(0, 10**6, 200))) for i, _ in rows]
    assert {r["doc_id"]: r["class_id"] for r in dartminhash.near_dedup(spark.createDataFrame(more, DOCS)).collect()} == want


def test_large_buckets_lose_no_link_of_repeated_rows(spark, monkeypatch):
    """One bucket for all, in blocks, whose hub is like none: links come from the second round alone, also if rows stand there twice."""
    monkeypatch.setattr(dartminhash, "PAIRED", 2)
    monkeypatch.setattr(dartminhash, "BLOCK_ROWS", 7)
    one = lambda df, name: common.materialise(df.withColumn("bands", F.array_repeat(F.lit(7).cast("long"), dartminhash.BANDS)) if name == "signed" else df, name)
    monkeypatch.setattr(dartminhash, "materialise", one)
    rng = np.random.default_rng(6)
    text = lambda: [f"t{v}" for v in rng.integers(0, 10**6, 200)]
    rows, want = [(0, " ".join(text()))], set()
    for i in range(1, 40, 2):
        w = text()
        rows += [(i, " ".join(w)), (i + 1, " ".join([*w[:-1], "end"]))]
        want.add((i, i + 1))
    twice = rows * 2 + [(1, " ".join(text()))]  # and a doc_id of two texts
    links = dartminhash.near_links(spark.createDataFrame(twice, DOCS))[2]
    assert sorted((r["a"], r["b"]) for r in links.collect()) == sorted(want)


def test_signatures_estimate_the_weighted_similarity():
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = []
    for i in range(40):  # shingles of very different weights
        w = [f"t{v}" for v in np.minimum(rng.geometric(0.25, 400), 12)]
        texts += [" ".join(w), " ".join([*w[: 400 - 8 * i], *(f"u{v}" for v in rng.integers(0, 6, 8 * i))])]
    data, off = toxicity.K.text_buffer(pa.array([*texts, "", "one"]))
    found, times, to = dartminhash.shingle_counts(data, off)
    assert [int(times[a:b].sum()) for a, b in zip(to, to[1:])] == [396] * 80 + [0, 1]
    sig = dartminhash.signatures(found, dartminhash.weight(times), to)
    gap = [(sig[i] == sig[i + 1]).mean() - alike(shingles(texts[i]), shingles(texts[i + 1])) for i in range(0, 80, 2)]
    assert abs(np.mean(gap)) < 0.03 and np.abs(gap).max() < 0.25 and not sig[80].any() and sig[81].all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (201, 200), (200, 201)]
    got = {r["node"]: r["class_id"] for r in common.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)} | {200: 200, 201: 200}
    assert common.components(spark.createDataFrame([], "a long, b long")).count() == 0
