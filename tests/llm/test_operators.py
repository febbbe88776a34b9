"""Every operator against a brute-force version, an exact round trip or held-out labels, and on odd rows."""

import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from roleledger import scratch
from roleledger.llm import byte_bpe, copies, jaccard_join, line_templates, nn_descent, packing, passages, quality, queries, toxicity, url_filter, version_sketch
from roleledger.llm import components as components_module
from roleledger.llm.components import components
from roleledger.llm.copies import copy_classes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, least string, lang string"


def prose(seed, words, vocabulary=4000):
    pick = random.Random(seed)
    return " ".join(f"w{pick.randrange(vocabulary)}" for _ in range(words))


BASE = [prose(i, 120) for i in range(12)]
ROWS = [
    *((i, text) for i, text in enumerate(BASE)),
    (20, BASE[0]),
    (21, BASE[0].upper()),
    (22, BASE[1] + " extra words here"),
    (23, BASE[2][:300]),
    (24, None),
    (25, ""),
    (26, "two words"),
    (27, "two  words"),
    (28, BASE[3]),
    (28, BASE[3]),
    (None, BASE[4]),
    (None, "no id at all for this one"),
    (29, prose(99, 6000)),
    (30, BASE[5] + "\n" + BASE[6]),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, text, f"s{(i or 0) % 3}", "clash", "en") for i, text in ROWS]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7), (None, 3), (100, 101)]
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(1, 41)}, 101: 100, 102: 100}


def test_components_shuffle_once_a_round(spark, monkeypatch):
    # A large centre takes two rounds, since its small neighbours have no smaller one; the others hang together at random.
    pick = random.Random(5)
    links = [(1000, i) for i in range(1, 30)] + [(pick.randrange(2000, 2300), pick.randrange(2000, 2300)) for _ in range(200)]
    top = {x: x for link in links for x in link}
    for _ in top:
        for a, b in links:
            top[a] = top[b] = min(top[a], top[b])
    plans = []
    keep = lambda df, name: plans.append(df._jdf.queryExecution().executedPlan().toString()) or scratch.staged(df, name)
    monkeypatch.setattr(components_module, "staged", keep)
    found = {r["node"]: r["component"] for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {node: least for node, least in top.items() if node != least}
    assert 2 <= sum("Exchange hashpartitioning" in p for p in plans) and sum(p.count("Exchange hashpartitioning") for p in plans) <= 4


def test_operators_leave_their_result_only(spark, docs, monkeypatch, tmp_path):
    monkeypatch.setattr(scratch, "shared_dir", lambda spark: str(tmp_path))
    for name, job in (("groups", lambda: jaccard_join.jaccard_join(docs)), ("found", lambda: passages.passages(docs))):
        rows = job().count()
        left = [p.name.split("-")[0] for p in (tmp_path / "roleledger").iterdir()]
        assert left.count(name) == 1 and set(left) <= {"groups", "found"} and (rows or name == "found")


def brute_groups(rows):
    def shingle_set(text):
        words = (text or "").lower().split()
        return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()

    sets = [shingle_set(text) for _, text in rows]
    parent = list(range(len(rows)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 75 * len(a | sets[j]):
                parent[top(i)] = top(j)
    least = defaultdict(list)
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[top(i)].append(doc_id)
    return [(d, len(s), min(least[top(i)], default=None)) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))]


def order(rows):
    return sorted(rows, key=lambda row: tuple((v is None, v or 0) for v in row))


@pytest.mark.parametrize("share", [1 / 2048, 0.05])
def test_jaccard_join(spark, docs, share, monkeypatch):
    # With a small count, many shingles are frequent and pairs of them are indexed.
    monkeypatch.setattr(jaccard_join, "MIN_COUNT", 2)
    rows = [tuple(r)[:3] for r in jaccard_join.jaccard_join(docs, share=share).collect()]
    assert order(rows) == order(brute_groups(ROWS))


def test_small_buffers_change_nothing(spark, docs, monkeypatch):
    monkeypatch.setattr(jaccard_join, "CHUNK", 300)
    rows = [tuple(r)[:3] for r in jaccard_join.jaccard_join(docs).collect()]
    assert order(rows) == order(brute_groups(ROWS))


def test_members_of_an_entry_are_compared_in_cells(spark, monkeypatch, tmp_path):
    # Two families of texts with a common half each; within a family most pairs fall short of a link and some reach it.
    pick, rows = random.Random(3), []
    for family in range(2):
        common = [f"f{family}c{i}" for i in range(60)]
        for i in range(60):
            own = [f"f{family}o{i // 2}w{k}" for k in range(20)]
            own[pick.randrange(20)] = f"x{family}y{i}"
            rows.append((100 * family + i, " ".join(common + own)))
    table = spark.createDataFrame(rows, "doc_id long, text string")
    written, staged = {}, jaccard_join.staged

    def counted(df, name):
        out = staged(df, name)
        written.setdefault(name, []).append(out.count())
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    # No shingle is frequent, so that texts meet by the common half.
    monkeypatch.setattr(jaccard_join, "MIN_COUNT", 1000)
    for cell, tries in ((1024, 1 << 18), (7, 5)):
        monkeypatch.setattr(jaccard_join, "CELL", cell)
        monkeypatch.setattr(jaccard_join, "TRIES", tries)
        written.clear()
        found = [tuple(r)[:3] for r in jaccard_join.jaccard_join(table).collect()]
        assert order(found) == order(brute_groups(rows))
        # Of some 3,500 pairs in a family that share much and stay apart, none leaves the last comparison.
        assert written["cells"][-1] > 50 and written["across"][-1] < 100


def test_members_compared_with_all_others_leave_their_entry(spark, monkeypatch):
    # Texts in twos and threes that share half of their words: none needs the cells, and what goes there is small.
    rows = [(i, " ".join([f"s{2 + i // 30}g{i // (2 + i // 30)}w{k}" for k in range(60)] + [f"o{i}w{k}" for k in range(40)])) for i in range(60)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    written, staged = {}, jaccard_join.staged

    def counted(df, name):
        out = staged(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    monkeypatch.setattr(jaccard_join, "MIN_COUNT", 1000)
    found = [tuple(r)[:3] for r in jaccard_join.jaccard_join(table).collect()]
    assert order(found) == order(brute_groups(rows))
    assert written["shared"] > 0 and written["cells"] == 0
    tokens = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1500).astype(np.uint64))
    assert len(jaccard_join.bitmap(tokens)) <= len(tokens) / 2


def test_sets_with_few_rare_tokens_in_their_head(spark, docs, monkeypatch):
    written, staged = {}, jaccard_join.staged

    def counted(df, name):
        out = staged(df, name)
        written[name] = out.count()
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    monkeypatch.setattr(jaccard_join, "MIN_COUNT", 2)
    # With fewer tokens than entries need, every set is made again from its text.
    monkeypatch.setattr(jaccard_join, "head", lambda n, threshold: 0)
    rows = [tuple(r)[:3] for r in jaccard_join.jaccard_join(docs, share=0.05).collect()]
    assert order(rows) == order(brute_groups(ROWS))
    assert written["short"] > 10


def test_one_of_each(spark, docs, none):
    a, b, c = BASE[:3]
    rows = [(1, a), (5, a), (5, b), (7, c), (7, c), (None, a), (None, BASE[3]), (None, BASE[3]), (8, None), (8, None), (None, ""), (9, " \t")]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS).withColumnRenamed("least", "row_key").withColumnRenamed("lang", "d")
    kept = jaccard_join.one_of_each(table, jaccard_join.jaccard_join(table))
    assert kept.columns == table.columns
    found = [(r["doc_id"], r["text"]) for r in kept.collect()]
    key = lambda r: (r[0] is None, r[0] or 0, r[1] is None, r[1] or "")
    expected = [(1, a), (5, b), (7, c), (None, BASE[3]), (8, None), (8, None), (None, ""), (9, " \t")]
    assert sorted(found, key=key) == sorted(expected, key=key)
    assert jaccard_join.one_of_each(none, jaccard_join.jaccard_join(none)).count() == 0


def test_clusters_split_no_links(spark):
    """The classes that packing keeps apart hold every link of the join, on documents of the given tables."""
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    parts = jaccard_join.jaccard_join(table).where("part is not null").select("row_key", "part")
    classes = copy_classes(table.select(jaccard_join.row_key().alias("row"), "text").dropDuplicates(["row"]))
    by_part = defaultdict(set)
    for r in parts.join(classes, parts.row_key == classes.row).collect():
        by_part[r["part"]].add(r["class"])
    assert all(len(found) == 1 for found in by_part.values()) and len(by_part) > 400


def test_texts_are_cut_into_words_once(spark, docs, monkeypatch):
    plans = []
    keep = lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or scratch.staged(df, name)
    for module in (copies, packing, line_templates):
        monkeypatch.setattr(module, "staged", keep)
    for operator in (packing.pack_documents, line_templates.drop_recurring_lines):
        plans.clear()
        operator(docs).count()
        assert [(name, plan.count("lower(")) for name, plan in plans if "lower(" in plan] == [("sketches", 1)]
    # Lines are cut and masked in one plan.
    assert [name for name, plan in plans if "posexplode" in plan and "regexp_replace" in plan] == ["all-lines"]


def test_index_entries_meet():
    pick = np.random.default_rng(3)
    for size in (1, 2, 3, 4, 5, 9, 17, 60, 200):
        for _ in range(20):
            one = np.unique(pick.integers(0, 1 << 62, size).astype(np.uint64))
            drop = pick.integers(0, max(1, len(one) // 8) + 1)
            two = np.unique(np.concatenate([one[drop:], pick.integers(0, 1 << 62, pick.integers(0, max(1, size // 9) + 1)).astype(np.uint64)]))
            shared = len(np.intersect1d(one, two))
            if 100 * shared < 75 * len(np.union1d(one, two)):
                continue
            for frequent in (one[:0], one, one[::2]):
                a, b = (jaccard_join.index_entries(x, np.sort(frequent), jaccard_join.THRESHOLD) for x in (one, two))
                assert set(a[0]) & set(b[0]) or set(a[1]) & set(b[1])


def test_passages(spark):
    shared = prose(5, 80)
    edited = shared.split()
    edited[20], edited[50] = "changed", "altered words"
    rows = [
        (1, prose(11, 100) + " " + shared + " " + prose(12, 50)),
        (2, prose(13, 30) + " " + " ".join(edited) + " " + prose(14, 90)),
        (3, prose(15, 200)),
        (4, prose(16, 10) + " " + " ".join(shared.split()[:40])),
        (5, None),
        (None, shared),
        (6, ""),
    ]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    found = passages.passages(table).collect()
    assert [(r["doc_id"], r["source_id"]) for r in found] == [(2, 1)]
    assert abs(found[0]["start"] - 30) <= 1 and abs(found[0]["end"] - 111) <= 2
    assert abs(found[0]["source_start"] - 100) <= 1 and found[0]["matched"] >= 76
    left = {r["doc_id"]: r["text"] for r in passages.drop_passages(table, passages.passages(table)).collect()}
    assert left[1] == rows[0][1] and left[3] == rows[2][1] and left[5] is None
    assert shared.split()[30] not in left[2].split()[30:31] and len(left[2].split()) <= 123


def test_chains_are_the_best():
    at, other = np.array([0, 10, 20, 30, 40]), np.array([100, 5, 110, 120, 130])
    assert [c.tolist() for c in passages.chains(at, other)] == [[0, 2, 3, 4]]


def test_without():
    assert passages.without("a b  c\nd e", [(1, 3)]) == "a d e"
    assert passages.without("a b", [(0, 2)]) == ""


def test_url_filter(spark):
    urls = [
        None, "", "no scheme", "http://EXAMPLE.org/es/x?y", "https://a.b.example.org/en/12#z", "http://org", "http://org/",
        "ftp://x.com/fr/de/", "http://x.com/de/", "http://xorg/", "http://example.org/en/2", "http://com/de/", "http://?q",
    ]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")

    def expected(url):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = rest.replace("?", "/").replace("#", "/").split("/")[0]
        path = rest[len(host) :].split("?")[0].split("#")[0]
        host = host.lower()
        fits = [(len(h + p), h + p, v) for h, p, v in url_filter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        return (host, path, max(fits)[1], max(fits)[2]) if fits else (host, path, None, "allow")

    found = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.url_filter(pages, rules).collect()}
    assert found == {i: expected(url) for i, url in enumerate(urls)}
    assert url_filter.url_filter(pages.where("false"), rules).count() == 0
    assert {r["verdict"] for r in url_filter.url_filter(pages, rules.where("false")).collect()} == {"allow"}


def test_joined_lists_agree(spark, monkeypatch):
    pages = spark.read.parquet(f"{SF}/pages.parquet").select("page_id", "url")
    rules = spark.createDataFrame(url_filter.RULES, "host string, path string, verdict string")
    one = {tuple(r) for r in url_filter.url_filter(pages, rules).collect()}
    monkeypatch.setattr(url_filter, "MAX_LISTED", 0)
    assert {tuple(r) for r in url_filter.url_filter(pages, rules).collect()} == one


def test_sketches_recover_differences():
    pick = np.random.default_rng(1)
    for size in (0, 1, 5, 40, 700):
        both = pick.integers(0, 1 << 62, size).astype(np.uint64)
        left = np.concatenate([both, pick.integers(0, 1 << 62, size // 2 + 1).astype(np.uint64)])
        right = np.concatenate([both, pick.integers(0, 1 << 62, size // 3).astype(np.uint64)])
        tried = version_sketch.tables([left]).minus(version_sketch.tables([right]))
        _, keys, signs = version_sketch.differences([left], [right], tried)
        assert set(keys[signs == 1]) == set(left) - set(right) and set(keys[signs == -1]) == set(right) - set(left)


def test_fingerprints(spark, docs):
    rows = version_sketch.fingerprints(docs).collect()
    assert len(rows) == len(ROWS)
    ordered = sorted(((-1 if i is None else i, t or "") for i, t in ROWS))
    expected = defaultdict(list)
    for k, (i, text) in enumerate(ordered):
        quarter = len(text) // 4
        changed = text[: len(text) - quarter] + ordered[(k + 1) % len(ordered)][1][:quarter]
        expected[i].append((len(text), hashlib.sha256(changed.encode()).hexdigest()))
    found = defaultdict(list)
    for r in rows:
        found[-1 if r["doc_id"] is None else r["doc_id"]].append((r["n_chars"], r["edited_sha256"]))
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in expected.items()}
    prints = {r["doc_id"]: r["fingerprint"] for r in rows}
    assert prints[0] == prints[20] and len({prints[i] for i in range(12)}) == 12


def test_fingerprints_of_nothing(none):
    assert version_sketch.fingerprints(none).count() == 0


def accuracy(out, labels, label):
    truth = {r["doc_id"]: r[label] for r in labels.collect()}
    rows = [r for r in out.collect() if r["held_out"] and r["doc_id"] in truth]
    return np.mean([r["predicted"] == truth[r["doc_id"]] for r in rows]), rows


@pytest.mark.parametrize(("operator", "label", "folds", "own"), [(quality.quality, "quality", 4, 2), (toxicity.toxicity, "toxic", 5, 0)])
def test_classifiers_on_held_out_labels(spark, operator, label, folds, own):
    table, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    share, rows = accuracy(operator(table, labels, most=3000), labels, label)
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % folds == own for r in rows)
    assert share > 0.95


def test_classifiers_on_odd_rows(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    for operator in (quality.quality, toxicity.toxicity):
        rows = operator(docs, labels).collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)
        assert operator(none, labels).count() == 0
        assert operator(docs, labels.where("false")).count() == len(ROWS)


def test_insults_with_gaps_are_near():
    machine = toxicity.train(["idiot", "moron"], ["the", "there", "oneth", "ionta", "morning"])
    clean = machine.margin("the there oneth")
    assert machine.margin("the idiot there") > 0 > clean
    assert machine.margin("the id-iot there") > clean and machine.margin("idioot") > clean
    assert machine.margin("x" * 300_000 + " idiot") > 0


def test_nearest(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = defaultdict(list)
    for r in nn_descent.nearest(vectors, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append((r["vec_id"], r["score"]))
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in vectors.collect()}
    hits = 0
    for query in (i for i in rows if i % 20 == 0):
        best = sorted(((-float(rows[query] @ v), i) for i, v in rows.items() if i != query))[:20]
        hits += len({i for _, i in best} & {i for i, _ in found[query]})
        assert found[query] == sorted(found[query], key=lambda f: (-f[1], f[0]))
        assert all(abs(s - rows[query] @ rows[i]) < 1e-9 for i, s in found[query])
    assert hits >= 0.9 * 20 * len(found)


def test_nearest_among_copies(spark):
    """A third of all vectors equal, others in pairs: ties go to the smallest ids, in whatever block they lie."""
    pick = np.random.default_rng(5)
    base = pick.normal(size=(3000, 16)).astype(np.float32)
    base /= np.linalg.norm(base, axis=1, keepdims=True)
    vectors = np.concatenate([np.repeat(base[:1], 1500, 0), base[1:1500], base[1:1500]])
    ids = pick.permutation(len(vectors)) * 3
    table = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, vectors)], "vec_id long, embedding array<float>")
    found = defaultdict(list)
    for r in nn_descent.nearest(table, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["vec_id"])
    wide = vectors.astype(np.float64)
    hits = {True: [0, 0], False: [0, 0]}
    for at in np.flatnonzero(ids % 20 == 0):
        sims = np.round(wide @ wide[at], 12)
        near = [int(i) for _, i in sorted(zip(-sims, ids)) if i != ids[at]][:20]
        assert len(found[int(ids[at])]) == 20 and len(set(found[int(ids[at])])) == 20
        copied = hits[bool(at < 1500)]
        copied[0] += len(set(near) & set(found[int(ids[at])]))
        copied[1] += 20
    assert hits[True][0] == hits[True][1] and hits[False][0] >= 0.9 * hits[False][1]


def test_nearest_on_odd_rows(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [2.0, 0.0]), (None, [1.0, 1.0]), (1, [0.5, 0.5]), (7, [2.0, 0.0]), (8, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    found = [tuple(r) for r in nn_descent.nearest(table, F.col("vec_id") == 0).orderBy("rank").collect()]
    assert found == [(0, 1, 6, 2.0), (0, 2, 7, 2.0), (0, 3, 1, 0.5)]
    assert nn_descent.nearest(table.where("false"), F.col("vec_id") == 0).count() == 0


def test_packing(spark, docs, none):
    length, cluster = packing.word_count(F.col("text")), packing.text_cluster(F.col("text"))
    rows = packing.pack(docs, length, cluster, capacity=500, source_limit=2).collect()
    totals = defaultdict(int)
    for r in rows:
        totals[r["doc_id"]] += r["length"]
        assert r["length"] <= 500 and (r["bin"] is None) == (r["length"] == 0)
    assert totals[29] == 6000 and totals[None] == 127 and totals[28] == 240
    bins = defaultdict(list)
    for r in rows:
        bins[r["bin"]].append(r)
    del bins[None]
    assert all(sum(r["length"] for r in b) <= 500 for b in bins.values())
    same = {0, 20, 21}
    assert all(len([r for r in b if r["doc_id"] in same]) <= 1 and len([r for r in b if r["doc_id"] == 28]) <= 1 for b in bins.values())
    assert packing.pack(none, length, cluster).count() == 0


def test_packing_keeps_near_copies_apart(spark, monkeypatch):
    texts = []
    for i in range(12):
        words = BASE[0].split()
        words[10 + i] = f"edited{i}"
        texts.append(" ".join(words))
    rows = [(i, text, f"s{i}", "clash", "en") for i, text in enumerate([*texts, *BASE[1:]])]
    monkeypatch.setattr(queries, "documents", lambda spark, sf_dir: spark.createDataFrame(rows, DOCS))
    packed = queries.op8_packing(spark, "").collect()
    assert sum(r["length"] for r in packed) == 120 * len(rows)
    assert len({r["bin"] for r in packed if r["doc_id"] < 12}) == 12


def test_best_fit_is_tightest():
    assert packing.best_fit([(7, [0]), (6, [0]), (4, [0]), (3, [0])], 10) == [0, 1, 1, 0]
    assert packing.best_fit([(6, [1]), (5, [2]), (4, [1]), (4, [2])], 10) == [0, 1, 1, 0]


def test_byte_bpe(spark, docs):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    coder = byte_bpe.encoding(byte_bpe._ranks(path), public_tokenizers.PATTERN)
    for text in ("", "a b", "x  \n y's été 123 <|endoftext|>", "ab " * 50_000, " " * 200_000 + "end", "a" * 100_000):
        assert byte_bpe.encode(coder, text) == coder.encode_ordinary(text)
    rows = byte_bpe.bpe_round_trip(docs, path, public_tokenizers.PATTERN).collect()
    texts = defaultdict(set)
    for i, text in ROWS:
        texts[i].add(hashlib.sha256((text or "").encode()).hexdigest())
    assert len(rows) == len(ROWS) and all(r["decoded_sha256"] in texts[r["doc_id"]] for r in rows)
    coded = byte_bpe.bpe_decode(byte_bpe.bpe_encode(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert all(bytes(r["bytes"]).decode() == (r["text"] or "") for r in coded.collect())


def test_line_templates(spark, none):
    letters = str.maketrans("0123456789", "abcdefghij")
    rows = [(i, f"{prose(i, 8).translate(letters)}\nOrder number {i} was sent to you\n{prose(100 + i, 9)}") for i in range(30)]
    # Copies of one text are no boilerplate.
    rows += [(200 + i, "first line of a copied text\nsecond line of a copied text\nthird line of this") for i in range(30)]
    rows += [(300, None), (301, ""), (None, "Order number 9 was sent to you")]
    table = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], DOCS)
    found = {(r["doc_id"], r["text"]): r["_dropped"] for r in line_templates.drop_recurring_lines(table).collect()}
    expected = {}
    for i, text in rows:
        kept = [line for line in (text or "").split("\n") if not line.startswith("Order number")]
        expected[(i, None if text is None else "\n".join(kept))] = (text or "").count("Order number")
    assert found == expected
    assert line_templates.drop_recurring_lines(none).count() == 0


def test_long_lines_and_clashing_names(spark):
    """A line costs in proportion to its words, and columns of any name come through."""
    took = {}
    for count in (1000, 16_000):
        line = prose(1, count).translate(str.maketrans("0123456789", "abcdefghij"))
        rows = [(i, f"{line}\nown {prose(50 + i, 6)}", "n", "r", "d") for i in range(12)]
        table = spark.createDataFrame(rows, "doc_id long, text string, _numbers string, _row string, row string")
        begun = time.monotonic()
        found = line_templates.drop_recurring_lines(table, min_documents=3).collect()
        took[count] = time.monotonic() - begun
        # One class of near copies: nothing recurs.
        assert all((r["_numbers"], r["_row"], r["row"]) == ("n", "r", "d") and r["_dropped"] == 0 for r in found) and len(found) == 12
    assert took[16_000] < 5 * took[1000]


LETTERS = str.maketrans("0123456789", "abcdefghij")


def dropped_lines(spark, texts):
    """The different lines that are dropped from these texts."""
    table = spark.createDataFrame([(i, text, "x", "y", "z") for i, text in enumerate(texts)], DOCS)
    out = set()
    for r in line_templates.drop_recurring_lines(table).collect():
        kept = r["text"].split("\n")
        gone = [line for line in texts[r["doc_id"]].split("\n") if line not in kept]
        assert r["_dropped"] == len(texts[r["doc_id"]].split("\n")) - (len(kept) if r["text"] else 0)
        out |= set(gone)
    return out


def test_blocks_of_boilerplate_go_and_near_copies_stay(spark):
    block = ["the first line of a block", "this inner one stands in it", "and that one closes the block"]
    texts = ["\n".join([prose(i, 20).translate(LETTERS), *block, prose(500 + i, 20).translate(LETTERS)]) for i in range(27)]
    copied = [prose(900 + k, 25).translate(LETTERS) for k in range(6)]
    for i in range(40):
        lines = [line.split() for line in copied]
        lines[i % 6][i % 25] = prose(2000 + i, 1).translate(LETTERS)
        texts.append("\n".join(map(" ".join, lines)))
    assert dropped_lines(spark, texts) == set(block)


def test_short_recurring_lines_go(spark):
    short = ["Home", "All rights reserved.", "Page 0 end"]
    texts = []
    for i in range(20):
        lines = [f"{line}\n{prose(20 * i + k, 12).translate(LETTERS)}" for k, line in enumerate(short)]
        texts.append("\n".join([*lines, "", f"{i}", "rare one" if i < 5 else prose(7000 + i, 2).translate(LETTERS)]).replace("Page 0", f"Page {i}"))
    assert dropped_lines(spark, texts) == {*short[:2], *(f"Page {i} end" for i in range(20))}


def test_several_templates_a_leaf(spark):
    def words(seed, count):
        return prose(seed, count).translate(LETTERS)

    texts = []
    for i in range(40):
        # Two templates with the same lead, one with a field, among twice as many ordinary lines.
        lines = [f"thanks for reading {words(i, 4)}", f"thanks for reading {words(100 + i, 4)}"]
        if i < 12:
            lines.append("thanks for reading our weekly letter today")
        elif i < 24:
            lines.append(f"thanks for reading this post by {['anna', words(200 + i, 1)][i % 2]}")
        lines.append(f"I don't know {words(300 + i, 2)}")
        texts.append("\n".join(f"{line}\n{words(1000 + 10 * i + k, 15)}" for k, line in enumerate(lines)))
    posts = {line for text in texts for line in text.split("\n") if line.startswith("thanks for reading this post")}
    assert dropped_lines(spark, texts) == {"thanks for reading our weekly letter today", *posts}


def test_pipeline(spark):
    import corpus_pipeline

    assert [name for name, _ in corpus_pipeline.STAGES][-1] == "best-fit packing"
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {r["doc_id"] for r in corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert kept == {d for d, _, component in brute_groups(rows) if d == component}
    packed = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in packed} <= kept | {d for d, _ in rows} and len(packed) > 100
