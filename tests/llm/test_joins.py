import os
import random
import re
import uuid
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tessera.llm import common, jaccard, mixing, quality, topk
from tessera.llm.components import components
from tessera.llm.shingles import Shingler
from tests.llm.conftest import documents

# ------------------------------------------------------------------ shingles and the Jaccard join


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def brute(rows):
    """doc_id to (set size, component) from all pairs."""
    sets, parent = [(i, shingle_set(t)) for i, t in rows], {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    by = defaultdict(list)
    for k, (_, s) in enumerate(sets):
        for x in s:
            by[x].append(k)
    for k, (i, s) in enumerate(sets):
        find(i)
        for j, both in Counter(j for x in s for j in by[x] if j < k).items():
            if 100 * both >= 75 * (len(s) + len(sets[j][1]) - both):
                a, b = sorted((find(i), find(sets[j][0])))
                parent[b] = a
    return sorted((i, len(s), find(i)) for i, s in sets)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet="aAbÉé \t\n\v\x1c ", max_size=40), max_size=6))
def test_sets_match_tuples(texts):
    got = list(Shingler().sets(texts))
    assert [len(x) for x in got] == [len(shingle_set(t)) for t in texts]
    for i in range(len(texts)):
        for j in range(i):
            assert jaccard.overlap(got[i], got[j]) == len(shingle_set(texts[i]) & shingle_set(texts[j]))


def test_long_texts_hash_alike():
    shingler = Shingler()
    text = " ".join(f"w{i % 5000}" for i in range(400_000)) + " " + "y" * 2_500_000 + " end"
    whole = next(shingler.sets([text]))
    assert len(whole) == len(shingle_set(text))
    tail = next(shingler.sets([" ".join(text.split(" ")[-6:])]))
    assert jaccard.overlap(tail, whole) == len(tail) == 2


def near_copies(seed, n=260):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 6)))
    passage = [word() for _ in range(40)]
    bases = [[word() for _ in range(rng.choice((3, 6, 12, 40, 120)))] for _ in range(25)]
    rows = []
    for i in range(n):
        w = list(rng.choice(bases[:3] if i % 2 else bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2, 4))):
            k = rng.randrange(len(w) + 1)
            w[k : k + rng.randint(0, 2)] = [word() for _ in range(rng.randint(0, 2))]
        if rng.random() < 0.3:
            w = w + passage if rng.random() < 0.5 else passage + w
        rows.append((i, " ".join(w)))
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_join_matches_all_pairs(spark, monkeypatch, seed):
    monkeypatch.setattr(jaccard, "GROUP", 4)
    monkeypatch.setattr(jaccard, "WIDE_GROUP", 6)
    monkeypatch.setattr(jaccard, "LED", 8)
    rows = near_copies(seed)
    docs = documents(spark, [(i, t, "en", "a") for i, t in rows])
    got = jaccard.link(docs, rounds=1 + seed % 2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)


def test_join_matches_all_pairs_where_all_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    monkeypatch.setattr(jaccard, "NEED_ROWS", 0)
    rows = near_copies(4)
    got = jaccard.link(documents(spark, [(i, t, "en", "a") for i, t in [*rows, (None, "a row without an id")]])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows)
    some = spark.createDataFrame([(i,) for i in (3, 70_000, -5, 1 << 61)], "id long")
    wanted = jaccard.bits(some)
    at = np.array([r[0] for r in some.select(jaccard.bit()).collect()])
    assert (wanted[at >> 3] >> (at & 7) & 1 == 1).all() and np.unpackbits(wanted).sum() == 4


def test_join_leaves_its_result_on_disk_only(spark, monkeypatch, tmp_path):
    def shuffled():
        files = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
        return {x for x in files.split("\n") if "shuffle_" in x and x.endswith(".data")}

    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}/{uuid.uuid4().hex}")
    docs = documents(spark, [(i, t, "en", "a") for i, t in near_copies(5)])
    before = shuffled()
    written = common.materialize(jaccard.representatives(docs))
    assert sum(os.path.getsize(x) for x in shuffled() - before) < 2000  # of counts
    assert len(list(tmp_path.iterdir())) <= 9  # the rows and the components, what goes and what repeats, the result, and how four comparisons are blocked
    assert written.count() == len({c for _, _, c in brute(near_copies(5))})


def test_leaders_that_share_little_are_not_compared(spark, monkeypatch):
    rng = random.Random(7)
    words = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    rows = []
    for i in range(40):
        passage = words(12)
        rows += [(2 * i + k, " ".join(words(45) + passage + words(45))) for k in (0, 1)]
    rows += [(100 + i, rows[i][1] + f" end{i}") for i in range(10)]
    compared, compare = [], jaccard.compare
    monkeypatch.setattr(jaccard, "compare", lambda docs, need, *options: compared.append(need.filter("role = 1").count()) or compare(docs, need, *options))
    got = jaccard.link(documents(spark, [(i, t, "en", "a") for i, t in rows])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute(rows)
    assert 10 <= compared[0] <= 25 and max(compared[1:]) <= 25


def test_join_odd(spark, odd_documents, no_documents):
    got = jaccard.link(odd_documents).collect()
    rows = [(r.doc_id, r.text) for r in odd_documents.filter("doc_id is not null").collect()]
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got if r.doc_id is not None) == brute(rows)
    assert [(r.n_shingles, r.component_id) for r in got if r.doc_id is None] == [(4, None)]
    assert jaccard.link(no_documents).count() == 0
    kept = [r.doc_id for r in jaccard.representatives(odd_documents).collect()]
    assert sorted(kept, key=str) == sorted([1, 2, 3, 4, 5, 6, None, 7], key=str)


def test_repeated_ids_with_other_texts_stay(spark):
    rows = [(1, "one text of some seven words here", "en", "a"), (1, "One  text of some seven words here", "en", "a"), (1, "quite another text that has other words", "en", "a"), (2, "a third text that has nothing of the others", "en", "a")]
    kept = sorted((r.doc_id, r.text.lower().split()[0]) for r in jaccard.representatives(documents(spark, rows)).collect())
    assert kept == [(1, "one"), (1, "quite"), (2, "a")]


def test_join_links_are_bounded_below():
    for n in range(1, 60):
        for m in range(-(-75 * n // 100), 100 * n // 75 + 1):
            need = -(-75 * (n + m) // 175) - max(-(-75 * n // 100), -(-75 * m // 100)) + 1
            low, high = max(-(-75 * n // 100), m - 3), min(100 * n // 75, m + 3)
            ends = [-(-75 * (n + e) // 175) - max(-(-75 * n // 100), -(-75 * e // 100)) + 1 for e in (low, high)]
            assert max(1, min(ends) - (low < high)) <= max(1, need)


def test_components(spark):
    rng = random.Random(5)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(30)] + [(None, 3), (7, 7)]
    got = {r.id: r.component for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {x: x for a, b in links if a is not None and a != b for x in (a, b)}
    for _ in range(len(label)):
        for a, b in links:
            if a is not None and a != b:
                label[a] = label[b] = min(label[a], label[b])
    assert got == label


# ------------------------------------------------------------------ mixing


def expected_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    wanted, full, level = 1.5 * sum(sizes.values()), set(), 0.0
    while True:
        rest = sum(weight[s] for s in names if s not in full)
        level = (wanted - sum(2 * sizes[s] for s in full)) / rest if rest else level
        new = {s for s in names if s not in full and weight[s] * level > 2 * sizes[s]}
        if not new:
            return {s: 2.0 * sizes[s] if s in full else weight[s] * level for s in names}
        full |= new


def test_mix(spark):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(1, 3) for _ in range(rng.randint(0, 80))), "en", rng.choice(["b", "é", "Z", "a", None] + ["hot"] * 6)) for i in range(3000)]
    docs = documents(spark, rows)
    got = mixing.mix(docs.drop("target", "copies").withColumn("u", mixing.odds_rank(F.col("doc_id"), F.lit(0.5)))).collect()
    sizes = Counter()
    for _, t, _, s in rows:
        sizes[s] += len(t.split())
    aims = expected_targets(sizes)
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(aims[r.source]) and 0 <= r.copies <= 2
        taken[r.source] += r.copies * len(r.text.split())
    assert len(got) == len(rows)
    assert all(abs(taken[s] - aims[s]) <= 40 for s in aims)  # half of the longest document
    again = {r.doc_id: r.copies for r in mixing.mix(docs.drop("target", "copies").repartition(7)).collect()}
    assert again == {r.doc_id: r.copies for r in got}
    assert {r.doc_id: r.copies for r in got} == plain_mix([(r.doc_id, r.source, len(r.text.split()), r.u) for r in got], aims)
    # within a source long documents are expected more often, and each size as often as it is taken
    for s in aims:
        own = [r for r in got if r.source == s and r.size]
        assert sum(r.expected * r.size for r in own) == pytest.approx(aims[s])
        assert max(r.expected for r in own) <= 2 and (len({r.expected for r in own}) > 2 or aims[s] == pytest.approx(2 * sizes[s]))
        assert sorted(r.expected for r in own) == [r.expected for r in sorted(own, key=lambda r: (int(np.log2(r.size)), r.expected))]
    hot = [r for r in got if r.source == "hot" and 0.1 < r.expected < 1.9]
    for e in {r.expected for r in hot}:
        own = [r.copies for r in hot if r.expected == e]
        assert abs(np.mean(own) - e) < 4 * 0.5 / len(own) ** 0.5


def plain_mix(rows, aims):
    """id to copies: a scale by bisection, then Pareto order sampling in one sorted list for each source."""
    out = {}
    for source, aim in aims.items():
        own = [(i, n, u, 2.0 ** (int(np.log2(max(n, 1))) * 0.5)) for i, s, n, u in rows if s == source]
        low, high = 0.0, 1e6
        for _ in range(200):
            scale = (low + high) / 2
            low, high = (scale, high) if sum(min(2.0, scale * w) * n for _, n, _, w in own) < aim else (low, scale)
        left, ranked = aim, []
        for i, n, u, w in own:
            copies = min(2.0, high * w)
            copies = round(copies) if abs(copies - round(copies)) < 1e-9 else copies
            out[i] = int(copies)
            left -= n * out[i]
            if p := copies - out[i]:
                ranked.append(((u / (1 - u)) / (p / (1 - p)), i, n))
        at = 0
        for _, i, n in sorted(ranked):
            if at + n / 2 > left:
                break
            at += n
            out[i] += 1
    return out


def test_inclusion_frequencies(spark):
    rng = random.Random(8)
    docs = documents(spark, [(i, " ".join("w" * 1 for _ in range(rng.choice((1, 4, 20, 90)))), "en", rng.choice("aabc")) for i in range(1500)])
    taken, expected = Counter(), {}
    for seed in range(3):
        for r in mixing.mix(docs.drop("target", "copies"), seed=seed).collect():
            taken[r.source, r.size] += r.copies
            expected.setdefault((r.source, r.size), {})[r.doc_id] = r.expected
    assert len(expected) == 12
    for key, own in expected.items():
        each = next(iter(own.values()))
        assert abs(taken[key] / 3 / len(own) - each) < 5 * 0.5 / (3 * len(own)) ** 0.5 + 0.01


def test_mix_takes_in_order_of_rank(spark):
    docs = documents(spark, [(i, "a b c", "en", s) for i in range(4000) for s in ("x" if i % 4 else "y",)])
    rows = mixing.mix(docs.drop("target", "copies", "rank")).withColumn("rank", mixing.odds_rank(F.col("doc_id"), F.lit(0.4))).collect()
    for s in "xy":
        own = sorted((r.rank, r.copies) for r in rows if r.source == s)
        assert [c for _, c in own] == sorted((c for _, c in own), reverse=True)


def test_mix_odd(spark, odd_documents, no_documents):
    docs = odd_documents.drop("target", "copies")
    assert mixing.mix(docs).count() == 10 and mixing.mix(no_documents).count() == 0
    out = mixing.repeated(odd_documents)
    assert out.columns == odd_documents.columns and out.count() > 0 and mixing.repeated(no_documents).count() == 0


# ------------------------------------------------------------------ top-k


def brute_top(vectors, k):
    """vectors: (id, components) of all rows; the queries are those with ids divisible by 20, each once."""
    out = []
    for q, a in {(q, tuple(a)) for q, a in vectors if q % 20 == 0}:
        scores = sorted((-int(sum(int(x) * int(y) for x, y in zip(a, b, strict=True))), i) for i, b in vectors if i != q and len(a) == len(b))[:k]
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    return sorted(out)


def test_top_k(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_VALUES", 400)
    rng = np.random.default_rng(1)
    rows = [(i, [float(x) for x in rng.normal(size=6).round(1)]) for i in range(400)] + [(1000 + i, [0.5] * 6) for i in range(50)]
    rows += rows[3:6] * 2  # repeated rows are candidates of their own
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).collect()
    want = brute_top([(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in rows], 20)
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want


def searched(rows, k, queries=7):
    """(query number, candidate, score) sorted, and the share of list entries read."""
    ids = np.arange(len(rows))
    q = rows[:queries]
    a, b, s, entries = topk.no_random_access(q, ids[: len(q)], topk.Lists(rows, ids), k)
    return sorted(zip(a.tolist(), b.tolist(), s.astype(int).tolist(), strict=True)), entries / (len(q) * rows.size)


def all_pairs(rows, k, queries=7):
    scores, out = rows[:queries] @ rows.T, []
    for i, own in enumerate(scores):
        out += [(i, j, int(-s)) for s, j in sorted((-s, j) for j, s in enumerate(own) if j != i)[:k]]
    return sorted(out)


def test_top_k_stops_early_and_is_exact():
    rng = np.random.default_rng(4)
    for shape in ((3000, 3), (500, 64), (30, 5), (1, 2), (2000, 1)):
        for rows in (np.floor(rng.normal(size=shape) ** 3 * 20), rng.integers(-2, 3, shape).astype(float), np.zeros(shape)):
            assert searched(rows, 5)[0] == all_pairs(rows, 5)
    # a few rows far ahead in a few dimensions: outsiders cannot qualify after short heads of the lists
    skewed = np.floor(rng.standard_cauchy((8000, 12)) * 20)
    found, share = searched(skewed, 10, 60)
    assert found == all_pairs(skewed, 10, 60) and share < 0.3
    # nothing of the kind: the lists are read to their ends, once
    even = np.floor(rng.normal(size=(4000, 64)) * 8)
    found, share = searched(even, 20)
    assert found == all_pairs(even, 20) and share <= 1


def test_bounds_hold_at_every_depth():
    rng = np.random.default_rng(7)
    rows, q = np.floor(rng.normal(size=(200, 8)) * 30), np.floor(rng.normal(size=(9, 8)) * 30)
    lists, exact = topk.Lists(rows, np.arange(200)), q @ rows.T
    for n, depth in enumerate(lists.depths):
        for i, most in enumerate(lists.outsiders(q)[:, n]):
            seen = set(lists.read(q[i], int(depth), -np.inf, 10**6, -1).tolist())
            assert all(exact[i, j] <= most for j in range(200) if j not in seen)
            # with the k-th best score as bound no one of the best k is lost
            top = np.sort(exact[i])[-5]
            if most < top:
                assert set(np.flatnonzero(exact[i] >= top)) <= set(lists.read(q[i], int(depth), top, 5, -1).tolist())


def test_scores_of_any_size_sort():
    rng = random.Random(3)
    scores = [rng.choice((-1, 1)) * rng.getrandbits(rng.choice((3, 40, 61, 62, 63, 64, 65, 120, 131))) for _ in range(400)] + [0, 2**62, -(2**62), 2**63, -(2**63)]
    key = lambda s: (lambda size, digits, near: (size, digits or b"", near))(*topk.sortable(s))
    assert [key(s) for s in sorted(scores)] == sorted(map(key, scores))


def test_top_k_odd(spark):
    big = [3e9, -3e9]
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [float("nan"), 1.0]), (4, [float("inf"), 1.0]), (5, []), (None, [1.0, 1.0]), (6, [1.0]), (20, [1.0, 2.0]), (40, big), (60, big)]
    rows += [(80, [1e17, 1.0]), (81, [1e17, 3e17]), (82, [-2e17, 5.0]), (83, [1e300, 1.0]), (100, np.linspace(-1, 1, 5000).tolist())]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"vector": F.lit("x"), "score": F.lit(1), "id": F.lit(2), "spot": F.lit(3), "query": F.lit(4)})
    got = topk.top_k(frame, F.col("vec_id") % 20 == 0, k=3).collect()
    fine = [(i, [int(np.floor(64 * x)) for x in v]) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = [(q, n, i, min(max(s, -(2**63)), 2**63 - 1)) for q, n, i, s in brute_top(fine, 3)]
    assert sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in got) == want
    assert topk.top_k(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


# ------------------------------------------------------------------ quality


def test_quality_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    rows = quality.judge(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    right = sum(r.predicted == r.quality for r in rows) / len(rows)
    assert len(rows) > 50 and right > 0.95


def test_sparse_sites_rest_on_their_prior(spark):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(1200):
        host = "good" if i % 2 else "bad"
        rows.append((i, f"text {rng.random()}", "p" if i < 1190 else "rare", host if i % 3 else "new" if i == 0 else host))
        labels.append((i, int(rng.random() < (0.95 if host == "good" else 0.2)), 0))
    out = {r.doc_id: r for r in quality.judge(documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    good, bad, new = out[1], out[2], out[0]
    assert good.host_posterior > 0.8 and bad.host_posterior < 0.35
    assert bad.host_posterior < new.host_posterior < good.host_posterior  # one document says little
    rare = out[1199]
    assert abs(rare.path_posterior - rare.host_posterior) < 0.1


def test_posteriors_match_plain_sums(spark):
    """All posteriors and scores from the evidence and labels, by loops."""
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice(("good", "text", "|", "##", "Of", "12")) for _ in range(rng.randint(1, 30))), rng.choice(("p", "q", None)), rng.choice(("a", "a", "a", "b", None))) for i in range(400)]
    labels = {i: int(rng.random() < (0.8 if rows[i][3] == "a" else 0.3)) for i in range(0, 400, 2)}
    got = {r.doc_id: r for r in quality.judge(documents(spark, rows), spark.createDataFrame([(i, y) for i, y in labels.items()], "doc_id long, quality int")).collect()}
    e = {i: labels[i] if i in labels and not got[i].held_out else got[i].evidence for i in got}
    paths, hosts = defaultdict(list), defaultdict(list)
    for i, _, path, host in rows:
        paths[host, path].append(e[i])
        hosts[host].append(e[i])
    prior = (sum(e.values()) + 0.5) / (len(e) + 1)

    def strength(groups, of):
        n = sum(map(len, groups.values()))
        between = sum(len(v) * (sum(v) / len(v) - of(k)) ** 2 for k, v in groups.items())
        chance = sum(of(k) * (1 - of(k)) for k in groups)
        within = sum(len(v) * of(k) * (1 - of(k)) for k, v in groups.items())
        spread = (between - chance) / n
        return min(max(within / n / spread - 1, quality.STRENGTHS[0]), quality.STRENGTHS[1]) if spread > 0 else quality.STRENGTHS[1]

    kh = strength(hosts, lambda _: prior)
    host = {h: (kh * prior + sum(v)) / (kh + len(v)) for h, v in hosts.items()}
    kp = strength(paths, lambda k: host[k[0]])
    odds = lambda p: np.log(p / (1 - p))
    for i, _, p, h in rows:
        own = paths[h, p]
        assert got[i].host_posterior == pytest.approx(host[h]) and got[i].path_posterior == pytest.approx((kp * host[h] + sum(own)) / (kp + len(own)))
        rest = (kh * prior + sum(hosts[h]) - e[i]) / (kh + len(hosts[h]) - 1)
        rest = (kp * rest + sum(own) - e[i]) / (kp + len(own) - 1)
        z = odds(min(max(got[i].evidence, 1e-6), 1 - 1e-6)) + odds(rest) - odds(prior)
        assert got[i].score == pytest.approx(1 / (1 + np.exp(-z)))


def test_quality_odd(spark, odd_documents, no_documents):
    labels = spark.createDataFrame([(1, 1, 0), (3, 0, 0), (5, 1, 0), (None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")
    assert quality.judge(odd_documents, labels).count() == 10
    assert {round(r.evidence, 6) for r in quality.judge(odd_documents, labels.limit(0)).collect()} == {0.5}
    assert quality.judge(no_documents, labels).count() == 0
