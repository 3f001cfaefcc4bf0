"""Deduplication, packing, mixing, sharding and the pipeline: brute force, round trips and awkward rows."""

import itertools
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tessera.llm import covertree_dedup as V
from tessera.llm import exact_dedup, langid, licences, lm_scoring, mixing, packing, sharding
from tessera.llm import minmax_dedup as M
from tessera.llm.queries import QUERIES
from tessera.llm.shared import components

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def test_exact_groups_of_awkward_rows(awkward, nothing):
    out = exact_dedup.groups_of_copies(awkward, keep="largest").collect()
    assert len(out) == awkward.count()
    by = defaultdict(list)
    for r in out:
        by[r.text_sha256].append(r)
    for rows in by.values():
        ids = [r.doc_id for r in rows if r.doc_id is not None]
        assert {r.keep_id for r in rows} == {max(ids)} and {r.group_size for r in rows} == {len(rows)} and sum(r.kept for r in rows) == 1
    smallest = exact_dedup.without_copies(awkward)
    assert smallest.columns == awkward.columns and sorted(r.doc_id for r in smallest.collect()) == [1, 3, 5, 6, 7, 8, 9, 10, 11, 12]
    assert exact_dedup.groups_of_copies(nothing).count() == 0
    with pytest.raises(ValueError):
        exact_dedup.groups_of_copies(awkward, keep="any")


def root(parent, x):
    while parent[x] != x:
        x = parent[x]
    return x


def plain_components(nodes, linked):
    parent = {n: n for n in nodes}
    for a, b in linked:
        a, b = root(parent, a), root(parent, b)
        parent[max(a, b)] = min(a, b)
    return {n: root(parent, n) for n in nodes}


def plain_near(texts, width, part, whole):
    sets = {}
    for i, t in texts.items():
        w = tuple((t or "").encode().lower().split())
        sets[i] = {w[k : k + width] for k in range(len(w) - width + 1)} if len(w) >= width else {w} if w else set()
    ids = sorted(texts)
    pairs = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and whole * len(sets[a] & sets[b]) >= part * len(sets[a] | sets[b])]
    return {i: len(s) for i, s in sets.items()}, plain_components(ids, pairs)


def near_family(rng, n, words, edits):
    base = [str(w) for w in rng.choice(words, 120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.integers(0, edits)):
            w[rng.integers(len(w))] = str(rng.choice(words))
        out.append(" ".join(w))
    return out


def test_near_duplicates_equal_all_pairs(spark):
    rng = np.random.default_rng(2)
    words = np.array([f"t{i}" for i in range(3000)])
    texts = near_family(rng, 60, words, 9) + near_family(rng, 40, words, 4) + near_family(rng, 25, words, 14) + [" ".join(rng.choice(words, rng.integers(1, 90))) for _ in range(60)]
    texts += [None, "", "one", "one two", "ONE two", "one\ttwo\x0b", texts[0], texts[0]]
    texts = {int(i): t for i, t in zip(rng.permutation(len(texts)), texts, strict=True)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    for width, similarity in ((3, (85, 100)), (5, (80, 100))):
        sizes, comps = plain_near(texts, width, *similarity)
        out = {r.doc_id: r for r in M.near_duplicates(df, width, similarity).collect()}
        assert {i: r.n_shingles for i, r in out.items()} == sizes
        assert {i: r.component_id for i, r in out.items()} == comps
        assert all(r.kept == (i == r.component_id) for i, r in out.items())


def test_blocks_link_what_hubs_leave_open():
    rng = np.random.default_rng(4)
    make = lambda: np.unique(rng.integers(0, 4000, 300).astype(np.uint64))
    base = make()
    sets = [np.unique(np.concatenate([base[rng.random(len(base)) > 0.05], make()[:10]])) for _ in range(12)] + [make() for _ in range(3)]
    few, many = [(i, i, s) for i, s in enumerate(sets[:6])], [(i, i, s) for i, s in enumerate(sets)]
    want = {(i, j) for i, a in enumerate(sets[:6]) for j, b in enumerate(sets) if i != j and 100 * len(np.intersect1d(a, b)) >= 85 * len(np.union1d(a, b))}
    assert set(M.links_of_block(few, many, 85, 100)) == want and want


def test_near_duplicates_of_awkward_rows(awkward, nothing):
    out = M.near_duplicates(awkward).collect()
    assert len(out) == awkward.count()
    by = {r.doc_id: r for r in out}
    assert by[2].component_id == 1 and by[8].component_id == 7 and by[3].n_shingles == 0 and by[3].kept and by[4].kept
    assert by[None].component_id is None and by[None].kept
    kept = M.without_near_duplicates(awkward)
    assert kept.columns == awkward.columns and Counter(r.doc_id for r in kept.collect()) == Counter([1, 3, 4, 5, 7, None, 9, 10, 11, 12, 6] if by[6].kept else [1, 3, 4, 5, 7, None, 9, 10, 11, 12])
    assert M.near_duplicates(nothing).count() == 0 and M.without_near_duplicates(nothing).count() == 0


def test_components_of_paths_and_stars(spark):
    rng = np.random.default_rng(1)
    order = [int(x) for x in rng.permutation(400)]
    edges = list(zip(order[:200], order[1:200], strict=False)) + [(order[200], x) for x in order[201:300]] + [(5, 5)]
    out = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = plain_components({x for e in edges for x in e}, edges)
    assert {n: c for n, c in want.items() if n in out} == out and len(out) >= 299


def clustered(rng, n, dim=24):
    centres = rng.normal(size=(n // 6, dim))
    return np.concatenate([centres + rng.normal(scale=s, size=centres.shape) for s in (0, 0.05, 0.1, 0.14, 0.18, 1.0)])


def plain_links(x, cosine):
    u = x / np.linalg.norm(x, axis=1)[:, None]
    c = (u @ u.T) >= cosine
    np.fill_diagonal(c, False)
    return c


def test_dual_traversal_equals_all_pairs():
    rng = np.random.default_rng(0)
    for n in (6, 60, 600):
        x = np.concatenate([clustered(rng, n), np.ones((50, 24)) + rng.normal(scale=1e-3, size=(50, 24))])
        u = np.array([V.unit(list(v)) for v in x])
        want = plain_links(x, 0.98)
        links, _, forest = V.linked_pairs(u, np.ones(len(u), np.int64), None, None, 0.98)
        assert (links == want.sum(1)).all()
        assert plain_components(range(len(u)), forest) == plain_components(range(len(u)), list(map(tuple, np.argwhere(want))))
        k = len(u) // 3
        a, b, _ = V.linked_pairs(u[:k], np.ones(k, np.int64), u[k:], np.full(len(u) - k, 2), 0.98)
        assert (a == 2 * want[:k, k:].sum(1)).all() and (b == want[:k, k:].sum(0)).all()


def test_blocks_of_many_links_take_little_time():
    rng = np.random.default_rng(2)
    centre = np.ones(64) / 8
    for noise in (0.012, 0.017, 0.02):
        a, b = (np.array([V.unit(list(v)) for v in centre + rng.normal(size=(2048, 64)) * noise]) for _ in range(2))
        n = np.ones(2048, np.int64)
        began = time.process_time()
        la, lb, edges = V.linked_pairs(a, n, b, n, 0.98)
        assert time.process_time() - began < 3
        linked = a @ b.T >= 0.98
        assert (la == linked.sum(1)).all() and (lb == linked.sum(0)).all() and len(edges) >= ((la > 0).sum() + (lb > 0).sum()) // 2


@pytest.mark.parametrize(("block", "pivots", "levels"), [(64, 64, 24), (16, 3, 24), (32, 4, 1), (100_000, 64, 24)])
def test_near_vectors_in_blocks(spark, monkeypatch, block, pivots, levels):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "PIVOTS", pivots)
    monkeypatch.setattr(V, "LEVELS", levels)
    rng = np.random.default_rng(9)
    x = clustered(rng, 300)
    labels = [int(v) for v in rng.choice([0, 0, 0, 1], len(x))]
    rows = [(i, [float(f) for f in v], g) for i, (v, g) in enumerate(zip(x, labels, strict=True))]
    rows += [(900, None, 0), (901, [0.0] * 24, 0), (902, [1.0, None], 0), (903, [float("nan")] * 24, 0), (904, rows[0][1], None), (905, rows[0][1], labels[0]), (905, rows[0][1], labels[0]), (906, [], 0), (907, [2.0 * v for v in rows[0][1][:5]], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    out = sorted(V.near_vectors(df).collect(), key=lambda r: r.vec_id)
    full = np.concatenate([x, [x[0], x[0]]])
    ids, group = np.array([*range(len(x)), 905, 905]), np.array([*labels, labels[0], labels[0]])
    want = plain_links(full, 0.98) & (group[:, None] == group[None, :])
    comps = plain_components(sorted(set(ids.tolist())), [(int(ids[i]), int(ids[j])) for i, j in np.argwhere(want)])
    got = defaultdict(list)
    for r in out:
        got[r.vec_id].append(r)
    for i, n in zip(ids.tolist(), want.sum(1).tolist(), strict=True):
        assert {r.n_links for r in got[i]} == {n} and {r.component_id for r in got[i]} == {comps[i]}
    assert all((r.n_links, r.component_id, r.kept) == (0, i, True) for i in (900, 901, 902, 903, 904, 906, 907) for r in got[i])
    assert V.near_vectors(df.where("false")).count() == 0


def test_near_vectors_of_dense_balls(spark, monkeypatch):
    """Nodes of which every pair links are settled as a whole, against all pairs."""
    monkeypatch.setattr(V, "BLOCK", 24)
    monkeypatch.setattr(V, "PIVOTS", 4)
    monkeypatch.setattr(V, "BROADCAST_BYTES", 0)  # pivots by a join
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 16))
    x = np.concatenate([c + rng.normal(scale=s, size=(90, 16)) for c in centres for s in (0.002, 0.05)])
    x = np.concatenate([x, x[:40]])
    rows = [(f"v{i:04d}", [float(f) for f in v], "a", 1, "s") for i, v in enumerate(x)]
    out = {r.vec_id: r for r in V.near_vectors(spark.createDataFrame(rows, "vec_id string, embedding array<double>, label string, place int, unit string")).collect()}
    want = plain_links(x, 0.98)
    comps = plain_components(list(range(len(x))), list(map(tuple, np.argwhere(want))))
    assert [(out[f"v{i:04d}"].n_links, out[f"v{i:04d}"].component_id) for i in range(len(x))] == [(int(n), f"v{comps[i]:04d}") for i, n in enumerate(want.sum(1))]


def test_tables_are_measured_before_they_are_broadcast(spark, monkeypatch):
    from tessera.llm import shared

    df = shared.cut(spark.range(100).selectExpr("id", "repeat('x', 50) AS s", "array(id, id) AS a", "cast(null as string) AS n"), "measured")
    assert shared.bytes_of(df) == 100 * (shared.ROW_BYTES + 8 + 50) + sum(len(f'{{"a":[{i},{i}]}}') for i in range(100))
    plan = lambda: df.join(shared.small_or_shuffled(df), "id")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan()
    monkeypatch.setattr(shared, "BROADCAST_BYTES", 100)
    assert "strategy=broadcast" not in plan()
    assert shared.bytes_of(df.where("false")) == 0
    shared.discard(df)
    with pytest.raises(Exception):
        df.count()


def test_ids_of_text(spark, awkward):
    """Ids of any type: the same results as with numbers."""
    rows = awkward.withColumn("doc_id", F.concat(F.lit("d"), F.lpad(F.col("doc_id").cast("string"), 3, "0")))
    a, b = ({str(r.doc_id)[-3:].lstrip("d0"): (r.n_shingles, str(r.component_id).lstrip("d0"), r.kept) for r in M.near_duplicates(d).where("doc_id is not null").collect()} for d in (rows, awkward))
    assert a == b
    assert {r.doc_id for r in packing.pack(rows, TOKENIZER).collect()} == {r.doc_id for r in rows.collect()}
    assert {r.doc_id for r in licences.scan_licences(rows).collect()} == {r.doc_id for r in rows.collect()}
    good = spark.createDataFrame([("d001",)], "doc_id string")
    assert {r.doc_id for r in lm_scoring.score(rows, *lm_scoring.train(rows, good)).collect()} == {r.doc_id for r in rows.collect()}
    assert {r.doc_id for r in langid.identify(rows.select("doc_id", "text"), langid.train(rows)).collect()} == {r.doc_id for r in rows.collect()}


def test_texts_that_share_an_id_are_told_apart(spark):
    base = " ".join(f"w{i}" for i in range(300))
    rows = [(7, "some other text that is like no other one at all here"), (7, base), (3, base + " more"), (9, "x " + base), (7, base)]
    out = sorted((r.doc_id, r.n_shingles, r.component_id) for r in M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert out == [(3, 297, 3), (7, 8, 7), (7, 296, 3), (7, 296, 3), (9, 297, 3)]


def check_packing(texts, out, encode):
    """texts: (id, text) rows. Every id is in exactly one piece; sequences are gapless."""
    want = Counter()
    ids = {i: np.array([*encode(t or ""), 1], "<u4") for i, t in texts}
    times = Counter(i for i, _ in texts)
    covered = Counter()
    for r in out:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and zlib.crc32(own[r.start : r.start + r.length].tobytes()) == r.ids_crc32
        covered[r.doc_id] += r.length
        want[r.sequence_id] += r.length
    assert covered == Counter({i: n * len(ids[i]) for i, n in times.items()})
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    return sum(0 if n & (n - 1) == 0 else packing.CAPACITY - n for n in want.values()) / max(1, sum(want.values()))


def test_packing(spark, sf, documents, awkward, nothing):
    slow = Tokenizer.from_file(TOKENIZER)
    encode = lambda t: slow.encode(t, add_special_tokens=False).ids
    texts = [(r.doc_id, r.text) for r in documents.collect()]
    assert check_packing(texts, QUERIES["op6_packing"](spark, sf).collect(), encode) < 0.02
    check_packing([(r.doc_id, r.text) for r in awkward.collect()], packing.pack(awkward, TOKENIZER).collect(), encode)
    assert packing.pack(nothing, TOKENIZER).count() == 0
    same = spark.createDataFrame([(i, "word " * 1100) for i in range(50)], "doc_id long, text string")
    assert check_packing([(r.doc_id, r.text) for r in same.collect()], packing.pack(same, TOKENIZER).collect(), encode) < 0.05


texts = st.text(alphabet=st.one_of(st.characters(max_codepoint=0x24F), st.characters(), st.sampled_from(" \n\t'’“”—")), max_size=60)


@given(texts)
@settings(max_examples=300, deadline=None)
def test_both_tokenizers_agree(text):
    text = text.encode("utf-8", "ignore").decode()
    encode = encoder()
    assert encode(text) == encode.slow.encode(text, add_special_tokens=False).ids


def encoder(kept={}):  # noqa: B006
    if not kept:
        kept[0] = packing.Encoder(open(TOKENIZER, encoding="utf-8").read())
    return kept[0]


def test_special_strings_are_as_the_loaded_tokenizer_has_them(spark):
    untouched = Tokenizer.from_file(TOKENIZER)
    encode = lambda t: untouched.encode(t, add_special_tokens=False).ids
    texts = ["a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>é", "<|endoftext", "é <|endoftext|> 中"]
    assert [encoder()(t) for t in texts] == [encode(t) for t in texts] and 50256 in encoder()(texts[0])
    check_packing(list(enumerate(texts)), packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), TOKENIZER).collect(), encode)


@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 60)), min_size=1, max_size=12))
@settings(max_examples=40, deadline=None)
def test_column_generation(found):
    demand = Counter()
    for w, n in found:
        demand[w] += n
    weights, numbers = np.array(sorted(demand)), np.array([demand[w] for w in sorted(demand)], float)
    solution = packing.solve_patterns(weights, numbers, 40)
    covered = sum(c * x for c, x in solution)
    assert (covered >= numbers - 1e-6).all() and all(c @ weights <= 40 for c, _ in solution)
    lower = max((weights @ numbers) / 40, numbers[weights > 20].sum())
    assert sum(x for _, x in solution) >= lower - 1e-6
    used = packing.rounded(weights, numbers.astype(int), solution, 40, 0.0)
    assert (sum(c * n for c, n in used) <= numbers).all() if used else True


def test_targets():
    sizes = {"a": 100, "b": 100, "c": 1, None: 99}
    w = mixing.source_weights(list(sizes))
    assert w == {"a": 1, "b": 2, "c": 3, None: 1}
    t = mixing.source_targets(sizes, w)
    assert t["c"] == 3 and sum(t.values()) == pytest.approx(300) and t["b"] == pytest.approx(2 * t["a"])
    assert mixing.source_targets({}, {}) == {} and mixing.source_targets({"a": 0}, {"a": 1}) == {"a": 0}


def test_routes_repeat_no_pattern_while_another_is_free():
    flow = mixing.route({("a",): 100, ("a", "b"): 100, ("b",): 50}, {"a": 150, "b": 120})
    assert sum(f.get("a", 0) for f in flow.values()) == 150 and sum(f.get("b", 0) for f in flow.values()) == 120
    words = {("a",): 100, ("a", "b"): 100, ("b",): 50}
    assert sum(max(0, sum(f.values()) - words[p]) for p, f in flow.items()) == 270 - 250


def plain_routes(patterns, quotas, most):
    """(words routed, cost) of the best flow by trying all: the most words first, then the least cost."""
    arcs = [(p, s) for p in patterns for s in p]
    cost = lambda p, words: sum(r * min(patterns[p], max(0, words - r * patterns[p])) for r in range(most))
    best = None
    for flow in itertools.product(*[range(min(patterns[p] * most, quotas[s]) + 1) for p, s in arcs]):
        out, into = Counter(), Counter()
        for (p, s), words in zip(arcs, flow, strict=True):
            out[p] += words
            into[s] += words
        if all(out[p] <= most * patterns[p] for p in patterns) and all(into[s] <= quotas[s] for s in quotas):
            found = (-sum(flow), sum(cost(p, out[p]) for p in patterns))
            best = found if best is None else min(best, found)
    return -best[0], best[1]


@pytest.mark.parametrize("seed", range(12))
def test_routes_equal_the_best_of_all_flows(seed):
    rng = np.random.default_rng(seed)
    options = [("a",), ("b",), ("a", "b"), ("b", "c"), ("c",)]
    patterns = {options[i]: int(rng.integers(1, 4)) for i in rng.choice(5, 3, replace=False)}
    quotas = {s: int(rng.integers(0, 7)) for p in patterns for s in p}
    flow = mixing.route(patterns, quotas)
    out = {p: sum(f.values()) for p, f in flow.items()}
    cost = sum(sum(r * min(n, max(0, out[p] - r * n)) for r in range(3)) for p, n in patterns.items())
    assert (sum(out.values()), cost) == plain_routes(patterns, quotas, 3)
    into = Counter()
    for f in flow.values():
        into.update(f)
    assert all(into[s] <= quotas[s] for s in into) and all(out[p] <= 3 * patterns[p] for p in patterns)


def test_mixing(spark, sf, documents, awkward, nothing):
    out = QUERIES["op9_mixing"](spark, sf).collect()
    assert sorted(map(str, out)) == sorted(map(str, QUERIES["op9_mixing"](spark, sf).collect()))
    source = {r.doc_id: r.source for r in documents.collect()}
    size = {r.doc_id: len((r.text or "").encode().split()) for r in documents.collect()}
    taken, target = Counter(), {}
    for r in out:
        assert r.size == size[r.doc_id] and r.taken <= 3 * r.size and r.taken % max(1, r.size) == 0
        taken[source[r.doc_id]] += r.taken
        target[source[r.doc_id]] = r.target
    assert all(abs(taken[s] - t) <= 0.05 * t for s, t in target.items())
    mix = mixing.mixture(awkward)
    assert mix.columns == awkward.columns and max(Counter(map(str, mix.collect())).values()) <= 6
    assert mixing.mixed(nothing).count() == 0 and mixing.mixture(nothing).count() == 0


def test_mixing_of_overlapping_sources(spark):
    rows = [(i, "w " * (1 + i % 17), s) for i in range(900) for s in [(["a"], ["a", "b"], ["b", "c"])[i % 3]]]
    df = spark.createDataFrame(rows, "doc_id long, text string, tags array<string>")
    out = mixing.mixed(df, "tags").collect()
    sizes, taken = Counter(), Counter()
    for r in out:
        sizes[tuple(r.sources)] += r.size
        taken[tuple(r.sources)] += r.taken
    own = Counter()
    for p, n in sizes.items():
        for s in p:
            own[s] += n
    targets = mixing.source_targets(own, mixing.source_weights(list(own)))
    flow = mixing.route(dict(sizes), targets)
    assert {p: sum(f.values()) for p, f in flow.items()} == pytest.approx(dict(taken), abs=2) and all(r.taken <= 3 * r.size for r in out)


def check_shards(rows, out, share=sharding.GROUP_SHARE):
    """Rows as given, gapless slots, one global order by the group's least id, even bytes, and small groups whole."""
    text = Counter((r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in out) == text
    number = lambda i: -1 if i is None else i
    lead, together, shards = {}, Counter(), defaultdict(set)
    for r in out:
        if r.doc_id is not None:
            lead[r.text_crc32] = min(lead.get(r.text_crc32, r.doc_id), r.doc_id)
        together[r.text_crc32] += r.size
        shards[r.text_crc32].add(r.shard)
    by = defaultdict(list)
    for r in out:
        by[r.shard].append((r.slot, number(lead.get(r.text_crc32)), number(r.doc_id), r.size))
    order = [x[1:3] for s in sorted(by) for x in sorted(by[s])]
    assert order == sorted(order) and all([x[0] for x in sorted(rows)] == list(range(len(rows))) for rows in by.values())
    total = sum(r.size for r in out)
    limit = share * total / 16
    assert all(len(shards[c]) == 1 for c, n in together.items() if n <= limit)
    most = max([r.size for r in out] + [n for n in together.values() if n <= limit])
    assert all(abs(sum(x[3] for x in by[s]) - total / 16) <= most for s in by)


def test_sharding(spark, sf, documents, awkward, nothing):
    check_shards(documents.collect(), QUERIES["op10_sharding"](spark, sf).collect())
    check_shards(awkward.collect(), sharding.balanced_shards(awkward).collect())
    assert sharding.balanced_shards(nothing).count() == 0
    # Groups of two to sixty copies, and one text that is a third of all rows.
    rows = [(i, "hot" if i % 3 == 0 else f"text {(i * i) % 700 if i % 5 else i % 11} " + "x" * (i % 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check_shards(df.collect(), sharding.balanced_shards(df).collect())


def test_pipeline(spark, sf, documents):
    import corpus_pipeline

    docs, seen = documents, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf)
        rows = docs.collect()
        seen.append(rows)
        if k < 4:
            assert docs.columns == documents.columns
            docs = spark.createDataFrame(rows, documents.schema)
    given = documents.collect()
    assert len(seen[0]) == sum(any(c.isalpha() for c in r.text or "") for r in given)
    assert Counter(r.text for r in seen[1]) == Counter({r.text for r in seen[0]})
    _, comps = plain_near({r.doc_id: r.text for r in seen[1]}, 5, 80, 100)
    assert sorted(r.doc_id for r in seen[2]) == sorted(set(comps.values()))
    assert {r.doc_id for r in seen[3]} <= {r.doc_id for r in seen[2]}
    slow = Tokenizer.from_file(TOKENIZER)
    check_packing([(r.doc_id, r.text) for r in seen[3]], seen[4], lambda t: slow.encode(t, add_special_tokens=False).ids)


def test_pipeline_deletes_what_it_no_longer_needs(spark, tmp_path, documents):
    import corpus_pipeline
    from tessera.llm import shared

    documents.withColumn("lang", F.lit(None).cast("string")).write.parquet(str(tmp_path / "documents.parquet"))
    since = shared.mark()
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    left = [path.rsplit("/", 1)[1].split("-")[1] for _, path in shared._written[since:]]
    assert rows and left.count("corpus") == 1 and not {"hashes", "signed", "sizes"} & set(left)
    # No label, no model: no document is rejected.
    assert corpus_pipeline.identify_language(spark, spark.read.parquet(str(tmp_path / "documents.parquet")), "").count() == documents.count()


def test_pipeline_rejects_scripts_that_no_label_has(spark, documents):
    import corpus_pipeline

    own = spark.createDataFrame([(-1, "\u0e2a\u0e27\u0e31\u0e2a\u0e14\u0e35 \u0e04\u0e23\u0e31\u0e1a", None, "t", 9), (-2, "1234", None, "t", 4), (-3, "the river", None, "t", 9)], documents.schema)
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, documents.unionByName(own), "").collect()}
    assert -1 not in kept and -2 not in kept and -3 in kept


def test_pipeline_of_awkward_rows(spark, awkward, nothing, sf):
    import corpus_pipeline

    for start in (awkward, nothing):
        docs = start
        for _, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, sf)
            rows = docs.collect()
            docs = spark.createDataFrame(rows, docs.schema)
        assert bool(rows) == (start is awkward)
