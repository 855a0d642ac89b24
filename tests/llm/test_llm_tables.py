"""Operators that compare rows, learn from tables or move rows, and the pipeline."""

import random
import re
import zlib
from collections import Counter

import llm_cases as C
import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

import corpus_pipeline
from forumlens.llm import decontamination, neardup, quality, registry, sharding, urls
from forumlens.llm.common import prepared, table


@pytest.fixture(autouse=True)
def ready(spark):
    prepared(spark)


# --- near duplicates ------------------------------------------------------------------------------------
def brute_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_groups(prints):
    parent = list(range(len(prints)))
    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i
    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def brute_components(ids, prints):
    roots = brute_groups(prints)
    least = {g: min((i for i, r in zip(ids, roots) if r == g and i is not None), default=None) for g in set(roots)}
    return [least[r] for r in roots]


def test_components_query_against_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents").select("doc_id", "text").toPandas()
    found = {r.doc_id: r for r in neardup.BOOK.queries["op6_simhash_components"](spark, sf).collect()}
    prints = [brute_print(t) for t in docs.text]
    expected = brute_components(docs.doc_id.tolist(), prints)
    assert len(found) == len(docs)
    for i, p, c in zip(docs.doc_id, prints, expected):
        assert (found[i].fingerprint, found[i].component_id) == (f"{p:016x}", c)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2 ** 64 - 1), st.lists(st.integers(0, 63), max_size=3))
def test_linked_fingerprints_meet_at_an_anchor(a, bits):
    b = a
    for bit in bits:
        b ^= 1 << bit
    signed = np.array([a, b], np.uint64).view(np.int64)
    (x, _), (y, _) = neardup._replicas(signed[:1]), neardup._replicas(signed[1:])
    assert set(x.tolist()) & set(y.tolist()) and len(x) <= 34


def test_anchors_are_all_code_words_in_reach():
    half = np.array([0, 5, 0x80000001, 0xDEADBEEF], np.uint64)
    rows, anchors = neardup.anchors_of(half)
    assert (neardup._syndromes(anchors) == 0).all()
    assert (np.bitwise_count(anchors ^ half[rows]) <= 2).all()
    for r in range(len(half)):
        assert len(set(anchors[rows == r].tolist())) == (2 if neardup._syndromes(half[r:r + 1])[0] == 0 else 17)


def test_split_anchors_lose_no_link(spark, monkeypatch):
    rng = random.Random(4)
    centre = rng.getrandbits(64)
    prints = {centre}
    while len(prints) < 400:
        p = rng.choice(sorted(prints))
        for _ in range(rng.randrange(1, 6)):
            p ^= 1 << rng.randrange(64)
        prints.add(p)
    signed = np.array(sorted(prints), np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(p,) for p in signed], "fingerprint long")
    expected = brute_components(sorted(prints), sorted(prints))
    for hot in (20_000, 16):
        monkeypatch.setattr(neardup, "HOT_ANCHOR", hot)
        roots = {r.a: r.b for r in neardup.components(neardup.links(df)).collect()}
        root = [roots.get(p, p) for p in signed]
        assert len(set(zip(root, expected))) == len(set(root)) == len(set(expected))


def test_chains_become_one_component(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5)], "a long, b long")
    found = {r.a: r.b for r in neardup.components(edges).collect()}
    assert found == {**{i: 0 for i in range(1, 301)}, 1001: 1000}
    assert neardup.components(edges.filter("a < 0")).count() == 0


def test_hubs_are_joined_from_memory_with_the_same_result(spark, monkeypatch):
    rng = random.Random(8)
    pairs = [(0, i) for i in range(1, 200)] + [(500 + rng.randrange(80), 500 + rng.randrange(80)) for _ in range(70)] + [(199, 900), (900, 901)]
    edges = spark.createDataFrame(pairs, "a long, b long")
    found = []
    for hubs in (1, 3, 2048, 1 << 40):
        monkeypatch.setattr(neardup, "HUBS", hubs)
        found.append({r.a: r.b for r in neardup.components(edges).collect()})
    assert found[0] == found[1] == found[2] == found[3] and found[0][901] == 0 and len({v for k, v in found[0].items() if k < 200}) == 1
    rows = spark.createDataFrame([(i % 3 and i % 7, i) for i in range(60)], "k long, v long")
    side = rows.groupBy("k").count().withColumnRenamed("count", "__n").filter("k < 5")
    for how, n in (("inner", rows.filter("k < 5").count()), ("left", 60)):
        monkeypatch.setattr(neardup, "HUBS", 4)
        joined = neardup.with_looked_up(rows, side, "k", 60, how).collect()
        assert len(joined) == n and all((r["__n"] is None) == (r.k >= 5) for r in joined)


def test_near_duplicates_on_odd_rows(spark):
    docs = C.odd_documents(spark)
    got = neardup.components_of(docs).collect()
    rows = C.rows()
    expected = brute_components([r[0] for r in rows], [brute_print(r[1]) for r in rows])
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter(
        (r[0], f"{brute_print(r[1]):016x}", c) for r, c in zip(rows, expected))
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    groups = set(brute_groups([brute_print(r[1]) for r in rows]))
    assert kept.count() == len(groups) == len(set(brute_groups([brute_print(r.text) for r in kept.collect()])))
    assert neardup.one_of_each(C.no_documents(spark)).count() == 0
    alike = spark.createDataFrame([(1, "x", "a", None), (1, "x", None, "a"), (1, "x", None, "a")], "doc_id long, text string, lang string, source string")
    assert [tuple(r) for r in neardup.one_of_each(alike).collect()] in ([(1, "x", "a", None)], [(1, "x", None, "a")])


# --- decontamination --------------------------------------------------------------------------------------
def brute_hits(index, text, least=decontamination.SIMILARITY):
    words = decontamination.words_of(text or "")
    hashes = decontamination.shingle_hashes(words).tolist() if len(words) >= 5 else []
    out = set()
    for row, counts in enumerate(index.counts):
        span = min(int(index.sizes[row]), len(words)) - 4
        if any(decontamination.cosine(Counter(hashes[i:i + span]), counts, lambda s: 1 / index.has.get(s, 1)) >= least
               for i in range(len(hashes) - span + 1) if not counts.keys().isdisjoint(hashes[i:i + span])):
            out.add(index.ids[row])
    return out


def test_decontamination_query_against_brute_force(spark, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    index = decontamination.Index(items)
    texts = dict(table(spark, sf_dir, "documents").select("doc_id", "text").toPandas().itertuples(index=False))
    found = decontamination.BOOK.queries["op2_simhash_windows"](spark, sf_dir).collect()
    assert len(found) == len(texts) and any(r.contaminated for r in found)
    for r in found:
        assert set(r["items"]) == brute_hits(index, texts[r.doc_id]) and r.contaminated == bool(r["items"])


def test_edited_passages_are_found_and_fingerprints_stay_in_reach(spark, sf_dir):
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    index, rng = decontamination.Index(items), random.Random(6)
    seen = 0
    for _ in range(300):
        i, text = rng.choice(items)
        words = text.split()
        words[rng.randrange(len(words))] = f"changed{rng.randrange(99)}"
        doc = f"{C.PROSE} {' '.join(words).upper()} {C.PROSE}"
        expected, got = brute_hits(index, doc), index.hits(doc)
        assert {h["item_id"] for h in got} == expected
        seen += len(expected)
        for h in got:
            assert h["similarity"] >= 0.8 and 0 <= h["start"] < h["end"] <= len(doc)
    assert seen > 150


def test_blocks_find_every_fingerprint_in_the_radius():
    rng = random.Random(7)
    items = [(i, " ".join(f"w{rng.randrange(400)}" for _ in range(20))) for i in range(300)]
    index = decontamination.Index(items)
    prints = np.array([int(p) ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(30))) for p in index.prints], np.uint64)
    window, row = index.candidates(prints, np.arange(300))
    expected = {(w, r) for w in range(300) for r in range(300) if (int(prints[w]) ^ int(index.prints[r])).bit_count() <= decontamination.RADIUS}
    assert set(zip(window.tolist(), row.tolist())) == expected


def test_spans_are_those_of_the_text_as_it_is():
    index = decontamination.Index([(1, C.PROSE)])
    for front in ("", "\u0130\u0130\u0130 ", "\u0130a\u0130 \u1e9e "):
        text = f"{front}{C.PROSE.upper()} {front}"
        hit, = index.hits(text)
        assert text[hit["start"]:hit["end"]].lower() == C.PROSE.rstrip(".").lower()


def test_short_items_are_whole_lines(spark):
    index = decontamination.Index([(1, "What is it?"), (2, "?!"), (3, C.PROSE), (4, "what IS it")])
    text = f"What is it\nso what is it?\n{C.PROSE}\n - WHAT is it! "
    hits = index.hits(text)
    assert sorted((h["item_id"], text[h["start"]:h["end"]]) for h in hits if h["item_id"] != 3) == sorted(
        (i, t) for i in (1, 4) for t in ("What is it", "WHAT is it"))
    assert [h["item_id"] for h in index.hits(C.PROSE)] == [3] and index.hits("what is") == []
    bench = spark.createDataFrame([(1, "What is it?"), (2, "?!"), (3, None), (4, C.PROSE)], "item_id long, text string")
    assert decontamination.unsearched(bench) == 2


def test_decontamination_on_odd_rows(spark):
    docs = C.odd_documents(spark)
    bench = spark.createDataFrame([(1, C.PROSE), (2, None), (None, C.PROSE), (3, "too short"), (4, C.PROSE), (5, "")], "item_id long, text string")
    for block in (50_000, 2):
        found = decontamination.find(docs, bench, block_items=block).collect()
        assert {tuple(sorted({h.item_id for h in r.hits})) for r in found if r.text and C.PROSE in r.text} == {(1, 4)}
        assert all(not r.hits for r in found if not r.text or len(r.text) < 100)
    clean = decontamination.clean_rows(docs, bench)
    assert clean.columns == docs.columns and 0 < clean.count() < len(C.rows())
    assert decontamination.clean_rows(docs, bench.filter("item_id < 0")).count() == len(C.rows())
    assert decontamination.find(C.no_documents(spark), bench).count() == 0
    twice = decontamination.Index([(1, C.PROSE)]).hits(C.PROSE + " and once more: " + C.PROSE)
    assert len(twice) == 2


# --- quality --------------------------------------------------------------------------------------------
def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.1"
    found = quality.BOOK.queries["op8_positive_unlabelled_quality"](spark, sf).toPandas()
    labels = table(spark, sf, "labels").toPandas()
    assert (found.held_out == [zlib.crc32(str(i).encode()) % 4 == 2 for i in found.doc_id]).all()
    assert ((found.score >= 0.7) == (found.predicted == 1)).all() and found.score.between(0, 1).all()
    held = found[found.held_out].merge(labels, on="doc_id")
    assert (held.predicted == held.quality).mean() > 0.98
    assert held[held.quality == 1].predicted.mean() > 0.99 and held[held.quality == 0].predicted.mean() < 0.1


def test_risk_recovers_a_known_mixture():
    rng = np.random.default_rng(0)
    positive = rng.normal(2, 1, (800, 2))
    mixed = np.vstack([rng.normal(2, 1, (1200, 2)), rng.normal(-2, 1, (800, 2))])
    layers = quality.train(positive, mixed, 0.6, epochs=30)
    out = quality._sigmoid(quality._forward(mixed, layers)[1])
    assert out[:1200].mean() > 0.85 and out[1200:].mean() < 0.15
    assert 0.4 < quality.estimate_prior(positive, mixed) < 0.8


def test_quality_on_odd_rows(spark):
    docs = C.odd_documents(spark)
    labels = spark.createDataFrame([(0, 1), (0, 0), (1, None), (None, 1), (3, 0), (11, 1), (12, 0)], "doc_id long, quality int")
    model = quality.fit(docs, labels)
    found = quality.score(docs, model).collect()
    assert len(found) == len(C.rows()) and all(0 <= r.score <= 1 for r in found)
    same = {r.score for r in found if not (r.text or "").split()}
    assert len(same) == 1
    constant = quality.fit(docs, labels.filter("doc_id < 0"))
    assert {r.score for r in quality.score(docs, constant).collect()} == {0.5}
    assert quality.fit(C.no_documents(spark), labels).layers == ()
    assert quality.good_rows(docs, model).columns == docs.columns and quality.good_rows(C.no_documents(spark), model).count() == 0
    only_good = quality.fit(docs, labels.filter("quality = 1"))
    assert 0 < only_good.prior < 1


def test_scores_do_not_depend_on_the_batch(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    model = quality.fit(docs, table(spark, "/root/testdata/sf0.01", "labels"))
    texts = [r.text for r in docs.limit(300).collect()] + ["", None]
    whole = quality.scores(texts, model)
    for size in (1, 2, 7, 64):
        assert np.concatenate([quality.scores(texts[i:i + size], model) for i in range(0, len(texts), size)]).tolist() == whole.tolist()


def test_one_id_on_many_rows_does_not_fill_the_sample(spark):
    rows = [(7, C.PROSE if i % 2 else f"{C.PROSE} number {i}") for i in range(900)] + [(100 + i, f"{C.VARIED} {i}") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)] + [(100 + i, i % 2) for i in range(300)], "doc_id long, quality int")
    seen = []
    real, quality.train = quality.train, lambda positive, unlabelled, *a, **k: seen.append((len(positive), len(unlabelled))) or real(positive, unlabelled, *a, **k)
    try:
        quality.fit(docs, labels, positives=100, unlabelled=100)
    finally:
        quality.train = real
    assert seen and all(p < 160 and u < 160 for p, u in seen)


def test_the_prior_is_estimated_from_a_known_mixture():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.6, 0.9):
        n = 3000
        positive = rng.normal(2, 1, (n, 3))
        mixed = np.vstack([rng.normal(2, 1, (int(n * share), 3)), rng.normal(-2, 1, (n - int(n * share), 3))])
        rng.shuffle(mixed)
        assert abs(quality.estimate_prior(positive, mixed) - share) < 0.06


# --- URLs -----------------------------------------------------------------------------------------------
def test_urls_on_odd_rows(spark):
    rows = ["http://A.Example.ORG/es/x?q", "https://www.example.org/en/17", "ftp://com/fr/", "x://com/de/?a", None, "", "no scheme", "://", "http://",
            "http://notcom/de/", "http://a.com#/de/", "a://b://com/de/", "http://com/de", "http://x.org", "http://é.com/de/é\n?x", "http://x.org/?"]
    pages = spark.createDataFrame([(i, u, "old") for i, u in enumerate(rows)], "page_id long, url string, Host string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge(pages).collect()}
    assert [got[i] for i in range(len(rows))] == [
        ("a.example.org", "/es/x", "example.org/es/", "block"), ("www.example.org", "/en/17", "example.org/en/1", "block"),
        ("com", "/fr/", "com/fr/", "allow"), ("com", "/de/", "com/de/", "block"), ("", "", None, "allow"), ("", "", None, "allow"),
        ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("notcom", "/de/", None, "allow"), ("a.com", "", None, "allow"),
        ("b:", "//com/de/", None, "allow"), ("com", "/de", None, "allow"), ("x.org", "", None, "allow"),
        ("é.com", "/de/é\n", "com/de/", "block"), ("x.org", "/", "org/", "allow")]
    assert urls.judge(pages.filter("page_id < 0")).count() == 0
    assert {r.verdict for r in urls.judge(pages, rules=[], default="block").collect()} == {"block"}


def test_hosts_of_many_labels_take_few_keys(tmp_path):
    path = str(tmp_path / "digests")
    urls.write_digests(urls.RULES, path)
    d = urls.Digests(path)
    host = ".".join(["a"] * 16_000) + ".example.org"
    assert len(urls.keys_of(host, "/es/x", d.lengths, d.labels)) <= len(d.lengths) * len(d.labels) == 6
    assert urls.decide([host, "org"], ["/es/x", "/"], d, urls.ALLOW) == (["example.org/es/", "org/"], ["block", "allow"])


def test_digests_confirm_full_texts(tmp_path, monkeypatch):
    rules = [urls.Rule(f"h{i % 50}.example", f"/{i}/", urls.BLOCK if i % 2 else urls.ALLOW) for i in range(400)]
    monkeypatch.setattr(urls.xxhash, "xxh64_intdigest", lambda k: zlib.crc32(k) % 7)  # every hash collides
    path = str(tmp_path / "digests")
    urls.write_digests(rules, path)
    d = urls.Digests(path)
    keys = [f"{r.host}{r.path}".encode() for r in rules]
    assert [d.key(i) for i in d.find(keys)] == keys and d.find([b"h1.example/2/", b""]).tolist() == [-1, -1]
    assert [bool(d.verdicts[i]) for i in d.find(keys)] == [r.verdict == urls.BLOCK for r in rules]
    with pytest.raises(ValueError, match="not a rule"):
        urls.write_digests([urls.Rule("a", "no slash", urls.BLOCK)], path)


def test_url_query_equals_its_sql(spark, sf_dir):
    from oracle_check import compare, connect
    for name, sql in registry.oracle_sql().items():
        assert not compare(registry.queries()[name](spark, sf_dir), connect(sf_dir), sql)


# --- shards ---------------------------------------------------------------------------------------------
def check_shards(rows, shards, slack):
    by = {}
    for r in rows:
        by.setdefault(r.shard, []).append(r)
    assert set(by) <= set(range(shards))
    for part in by.values():
        assert sorted(r.slot for r in part) == list(range(len(part)))
    sizes = [sum(r["size"] for r in by.get(s, [])) for s in range(shards)]
    mean = sum(sizes) / shards
    assert max(abs(s - mean) for s in sizes) <= slack + 1e-4 * mean + 1, sizes


def test_shard_query(spark):
    sf = "/root/testdata/sf0.01"
    texts = dict(table(spark, sf, "documents").select("doc_id", "text").toPandas().itertuples(index=False))
    found = sharding.BOOK.queries["op7_histogram_shards"](spark, sf).collect()
    assert len(found) == len(texts)
    check_shards(found, 40, max(r["size"] for r in found))
    for r in found:
        raw = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 16, zlib.crc32(raw), "bytes", None)


@pytest.mark.parametrize("piece_rows", [7, 100_000])
def test_a_group_of_copies_is_cut_by_id(spark, piece_rows):
    rows = [(i, "the same long text " * 5 if i % 2 else f"text {i} " * (i % 9)) for i in range(600)] + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = sharding.shard(docs, shards=7, piece_rows=piece_rows).collect()
    assert len(found) == len(rows)
    check_shards(found, 7, 120)
    assert len({r.shard for r in found if r.doc_id is not None and r.doc_id % 2}) > 2


def brute_shards(rows, shards):
    """Cuts from a full sort: each where the bytes in front are nearest to its share."""
    total, out, shard, before = sum(s for _, s in rows), [], 0, 0
    for _, size in rows:
        while shard + 1 < shards and 2 * (total * (shard + 1) // shards - before) <= size:
            shard += 1
        out.append(shard)
        before += size
    return out


def test_cuts_equal_those_of_a_full_sort(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents").select("doc_id", "text")
    keyed = sharding._keys(docs, "text", "doc_id").select("doc_id", *sharding.KEY, "__size").collect()
    order = sorted(keyed, key=lambda r: tuple(r[c] for c in sharding.KEY))
    expected = brute_shards([(r.doc_id, r["__size"]) for r in order], 40)
    found = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, tolerance=0.0, piece_rows=7).collect()}
    slots = Counter()
    for r, shard in zip(order, expected):
        assert found[r.doc_id] == (shard, slots[shard])
        slots[shard] += 1


def test_wholly_equal_rows_are_cut(spark, tmp_path):
    rows = [(1, "one and the same row " * 4)] * 300 + [(None, None)] * 100 + [(i, f"row {i}") for i in range(200)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(5).write.parquet(f"{tmp_path}/docs")
    found = sharding.shard(spark.read.parquet(f"{tmp_path}/docs"), shards=8, piece_rows=11).collect()
    assert Counter((r.doc_id, r.text) for r in found) == Counter(rows)
    check_shards(found, 8, 200)
    assert len({r.shard for r in found if r.doc_id == 1}) > 5


def test_shards_on_odd_rows(spark):
    docs = C.odd_documents(spark)
    found = sharding.shard(docs, shards=3).collect()
    assert len(found) == len(C.rows()) and all(r["size"] == len((r.text or "").encode()) + 16 for r in found)
    check_shards(found, 3, len(C.LONG))
    assert sharding.shard(C.no_documents(spark)).count() == 0
    named = spark.createDataFrame([("b", "x"), ("a", "y"), (None, "x")], "doc_id string, text string")
    check_shards(sharding.shard(named, shards=2).collect(), 2, 17)


def test_shards_are_written_by_folder(spark, tmp_path):
    sharding.write_shards(sharding.shard(C.odd_documents(spark, clash=False), shards=3), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(C.rows())


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(*[st.one_of(st.integers(-2, 2), st.integers(-2 ** 63, 2 ** 63 - 1))] * 3), min_size=1, max_size=30))
def test_packed_keys_sort_like_tuples(pairs):
    packed = sharding.packed(*(np.array([p[i] for p in pairs]) for i in range(3)))
    assert sorted(pairs) == [p for _, p in sorted(zip(map(sharding.to_number, packed.tolist()), pairs))]


# --- pipeline and registry ----------------------------------------------------------------------------
def test_registry_names():
    names = registry.queries()
    assert {int(m[1]) for n in names if (m := re.match(r"op(\d+)_", n))} == set(range(1, 14)) and "pipeline" in names


def test_pipeline_stages_against_brute_force(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    columns, kept = docs.columns, [docs]
    for _, stage in corpus_pipeline.STAGES:
        kept.append(stage(spark, kept[-1], sf_dir).cache())
    assert [len(kept), *[k.columns == columns for k in kept[1:-1]]] == [6, True, True, True, True]
    ids = [{r.doc_id for r in k.select("doc_id").collect()} for k in kept]
    labels = {r.doc_id: r.quality for r in table(spark, sf_dir, "labels").collect()}
    wrong = [i for i, q in labels.items() if (i in ids[1]) != (q == 1)]
    assert len(wrong) <= 0.06 * len(labels)
    first = kept[1].select("doc_id", "text").toPandas()
    expected = brute_components(first.doc_id.tolist(), [brute_print(t) for t in first.text])
    assert ids[2] == set(expected)
    index = decontamination.Index([(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()])
    second = kept[2].collect()
    assert ids[3] == {r.doc_id for r in second if not brute_hits(index, r.text)}
    from test_llm_texts import brute_spans
    for r in kept[4].collect():
        assert not brute_spans(r.text) and r.n_chars == len(r.text)
    from forumlens.llm import pieces
    library = pieces.vocabulary(pieces.model_path()).library
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    last = kept[5].collect()
    assert {r.doc_id for r in last} == ids[4] == ids[3]
    assert all(r.ids == library.encode(texts[r.doc_id]) + [2] and r.decoded == texts[r.doc_id].replace("▁", " ") for r in last)
    for k in kept[1:]:
        k.unpersist()


def test_pipeline_run_on_odd_rows(spark, tmp_path, sf_dir):
    C.odd_documents(spark).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() <= len(C.rows())
    empty = tmp_path / "empty"
    C.no_documents(spark).write.parquet(f"{empty}/documents.parquet")
    for name in ("labels", "benchmark"):
        table(spark, sf_dir, name).limit(0).write.parquet(f"{empty}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
