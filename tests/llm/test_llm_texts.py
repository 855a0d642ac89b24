"""Operators that look at one text at a time, against brute force and the libraries."""

import hashlib
import random
import re
import zlib

import llm_cases as C
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from forumlens.llm import language, pieces, pii, rules, tokens
from forumlens.llm.common import hash_sample, id_fold, prepared, table

ALPHABET = " \n\t '''strevmld-XY09½٣.,!?é日ß　 _\U0001f600\x00▁́abcth"


@pytest.fixture(autouse=True)
def ready(spark):
    prepared(spark)


def documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text").toPandas()


# --- SentencePiece -----------------------------------------------------------------------------------
def own_ids(vocabulary, texts):
    offsets, flat = vocabulary.encode(texts)
    return [flat[a:b].tolist() for a, b in zip(offsets, offsets[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(ALPHABET, max_size=80), st.text(max_size=40)), max_size=6))
def test_pieces_equal_the_library(texts):
    texts = [None if t is None else t.encode("utf-8", "ignore").decode() for t in texts]
    v = pieces.vocabulary(pieces.model_path())
    expected = [v.library.encode(t or "") + [v.end] for t in texts]
    assert own_ids(v, texts) == expected
    assert [v.decode(i) for i in expected] == [v.library.decode(i) for i in expected]


def test_decoding_any_ids_equals_the_library():
    v, r = pieces.vocabulary(pieces.model_path()), random.Random(1)
    lists = [[r.randrange(r.choice([300, 32000])) for _ in range(r.randrange(25))] for _ in range(400)]
    assert [v.decode(i) for i in lists] == [v.library.decode(i) for i in lists]


def test_long_parts_and_a_full_store(monkeypatch):
    v = pieces.Vocabulary(pieces.model_path())
    monkeypatch.setattr(pieces, "STORE_PARTS", 50)
    texts = C.TEXTS + ["ab" * 300 + " tail", " ".join(f"w{i}" for i in range(200))]
    for _ in range(3):
        assert own_ids(v, texts) == [v.library.encode(t or "") + [v.end] for t in texts]


def test_a_difference_to_the_library_is_an_error(monkeypatch):
    v = pieces.Vocabulary(pieces.model_path())
    monkeypatch.setattr(v, "merge_rows", lambda parts: ([1] * len(parts), [5] * len(parts)))
    with pytest.raises(ValueError, match="differ"):
        v.encode(["hello"])


def test_sentencepiece_query(spark, sf_dir):
    v = pieces.vocabulary(pieces.model_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    texts = dict(documents(spark, sf_dir).itertuples(index=False))
    found = pieces.BOOK.queries["op5_sentencepiece"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        ids = v.library.encode(texts[r.doc_id]) + [v.end]
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(v.library.decode(ids)))


def test_pieces_on_odd_rows(spark):
    v = pieces.vocabulary(pieces.model_path())
    found = pieces.encode(C.odd_documents(spark)).collect()
    assert len(found) == len(C.rows())
    for r in found:
        assert r.ids == v.library.encode(r.text or "") + [v.end] and r.decoded == v.library.decode(r.ids)
    again = pieces.decode(pieces.encode(C.odd_documents(spark), decoded=None), decoded="back").collect()
    assert all(r.back == v.library.decode(r.ids) for r in again)
    assert pieces.encode(C.no_documents(spark)).count() == 0


# --- token counts -------------------------------------------------------------------------------------
def library_counts(texts):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(tokens.model_path())
    return [len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


PLAIN = st.one_of(st.text(ALPHABET, max_size=60), st.text("the antioshwr ", max_size=120), st.text(max_size=30))


@settings(max_examples=300, deadline=None)
@given(st.lists(PLAIN, max_size=5))
def test_token_counts_equal_the_library(texts):
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    assert [tokens.machine(tokens.model_path()).count(t) for t in texts] == library_counts(texts)


def chunked(machine, text, size):
    return machine.count_chunks([machine.chunk_map(text[i:i + size]) for i in range(0, len(text), size)])


@settings(max_examples=300, deadline=None)
@given(st.one_of(PLAIN, st.text("ab", max_size=90), st.text("x'lre", max_size=60)), st.sampled_from([1, 3, 17, 40]))
def test_chunk_maps_compose_to_the_count(text, size):
    text = text.encode("utf-8", "ignore").decode().replace("<|endoftext|>", "")
    assert chunked(tokens.machine(tokens.model_path()), text, size) == library_counts([text])[0]


def test_runs_meet_soon_and_maps_of_other_machines_hold():
    m, other = tokens.machine(tokens.model_path()), tokens.Machine(tokens.model_path())
    rng = random.Random(1)
    unbroken = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABC0123456789") for _ in range(60_000))
    maps = [other.chunk_map(unbroken[i:i + 6000]) for i in range(0, 60_000, 6000)]     # as another worker would make them
    read, real = [], m.run
    m.run = lambda state, text: read.append(len(text)) or real(state, text)
    try:
        state, total = m.start, 0
        for one in maps:
            state, added = m.follow(state, one)
            total += added
    finally:
        del m.run
    assert total + state.at_end == library_counts([unbroken])[0]
    assert sum(read) < 0.2 * len(unbroken)                          # of most chunks only the beginning is read again


def test_token_counts_of_contractions_and_special_strings(monkeypatch):
    texts = ["don't we'll  've '''s 'sun 'LL x'", "<|endoftext|>a b <|endoftext|>", "\n\n a", "'", "'r", "'re", "' s", "a's't", "x" * 500,
             "ab" * 3000, None, "", C.LONG]
    m = tokens.Machine(tokens.model_path())
    assert [m.count(t) for t in texts] == library_counts(texts)
    monkeypatch.setattr(tokens, "MAX_KEPT", 300)  # the machine is emptied again and again
    assert [m.count(t) for t in texts] == library_counts(texts)


def test_long_texts_are_read_in_chunks(spark):
    rng = random.Random(4)
    unbroken = "".join(rng.choice("abcdefgh0123") for _ in range(9_000))
    texts = [unbroken, "ab" * 3000, C.LONG[:9000], "short", None, "", unbroken, "x<|endoftext|>" + C.PROSE * 12 + "<|endoftext|>", "\n" * 4000 + "é" * 2000, C.PROSE]
    docs = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)], "doc_id long, text string, N_Tokens string").repartition(3)
    for size in (700, 5000):
        found = tokens.count_tokens(docs, long_chars=2000, chunk_chars=size).collect()
        assert {r.doc_id: r.n_tokens for r in found} == dict(enumerate(library_counts(texts))) and found[0].__fields__ == ["doc_id", "text", "n_tokens"]


def test_a_very_long_unbroken_text(spark):
    text = "".join(random.Random(5).choices("abcdefghijklmnopqrstuvwxyz0123456789+/", k=10_000_000))
    found = tokens.count_tokens(spark.createDataFrame([(1, text)], "doc_id long, text string"), keep=["doc_id"]).first()
    assert found.n_tokens == library_counts([text])[0]


def test_token_query_and_odd_rows(spark, sf_dir):
    docs = documents(spark, sf_dir)
    expected = dict(zip(docs.doc_id, library_counts(docs.text)))
    for r in tokens.BOOK.queries["op10_token_counts"](spark, sf_dir).collect():
        assert r.n_tokens == expected[r.doc_id] and r.over_limit == (r.n_tokens > 1024)
    found = tokens.judged(C.odd_documents(spark)).collect()
    assert [r.n_tokens for r in found] == library_counts([r.text for r in found])
    assert all(r.n_bytes == len((r.text or "").encode()) for r in found)
    assert tokens.judged(C.no_documents(spark)).count() == 0


# --- compression bands --------------------------------------------------------------------------------
def brute_rules(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)} if len(windows) < 3000 else None
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            None if covered is None else len(covered))


def test_rules_query_against_brute_force(spark, sf_dir):
    import zstandard
    pack = zstandard.ZstdCompressor(level=rules.LEVEL).compress
    texts = dict(documents(spark, sf_dir).itertuples(index=False))
    found = rules.BOOK.queries["op9_compression_bands"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        base = brute_rules(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == base[:4] and base[4] in (None, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        raw = texts[r.doc_id].encode()
        bad = [rules.out_of_band(len(c), len(pack(c))) != 0 for c in (raw[i:i + rules.CHUNK_BYTES] for i in range(0, len(raw), rules.CHUNK_BYTES))]
        inside = rules.out_of_band(len(raw), len(pack(raw))) == 0 and sum(bad) <= rules.BAD_CHUNK_SHARE * len(bad) if raw else True
        assert r.kept == (not r.base_failed and inside)


def test_rules_verdicts():
    import base64
    import os
    judge = rules._Judge(rules.BANDS, rules.CHUNK_BYTES, rules.BAD_CHUNK_SHARE, rules.LEVEL)
    prose = " ".join(f"{w}{i * i % 61}" for i in range(80) for w in C.PROSE.split()[i % 7::5])
    noise = " ".join(base64.b85encode(random.Random(i).randbytes(40)).decode() for i in range(300))
    assert judge(prose)[-1] == "in band" and judge(noise)[-1].startswith("incompressible") and not judge(noise)[6]
    assert judge("again and again and so on " * 400)[-1] == "repetitive"
    assert judge(None)[:7] == (0, 0, 0, 0, 0, True, False) and judge("")[7] is None
    assert rules.band_of(99) is None and rules.band_of(100).from_bytes == 100 and rules.band_of(10 ** 9).from_bytes == 100_000


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c", "\n", "d e"]), max_size=40))
def test_repeated_words_against_brute_force(parts):
    text = " ".join(parts)
    assert rules.repeat_words(text.encode().split()) == brute_rules(text)[4]
    assert rules.duplicate_lines(text.encode()) == brute_rules(text)[3]


def test_rules_on_odd_rows(spark):
    found = rules.judge(C.odd_documents(spark)).collect()
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines) == brute_rules(r.text)[:4] for r in found)
    kept = rules.passing(C.odd_documents(spark))
    assert kept.columns == C.odd_documents(spark).columns and 0 < kept.count() < len(found)
    assert rules.judge(C.no_documents(spark)).count() == 0


# --- personal data --------------------------------------------------------------------------------------
PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
            r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def brute_luhn(digits):
    total = 0
    for i, d in enumerate(digits[::-1]):
        total += int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d))))
    return total % 10 == 0


def brute_spans(text):
    out = []
    for label, pattern in enumerate(PATTERNS, 1):
        for m in re.finditer(pattern, text):
            digits = re.sub("[^0-9]", "", m.group())
            if (label == 1 or label == 2 and all(int(p) < 256 for p in m.group().split("."))
                    or label == 3 and 12 <= len(digits) <= 19 and brute_luhn(digits) or label == 4 and 9 <= len(digits) <= 15):
                out.append((m.start(), m.end(), label))
    return sorted(out, key=lambda s: (s[0], s[2]))


@settings(max_examples=400, deadline=None)
@given(st.one_of(st.text("0123456789999....--  ()+@@abz_%\n", max_size=70), st.text("0144 -+", min_size=10, max_size=60)))
def test_base_spans_equal_the_patterns(text):
    assert pii.base_spans(text) == brute_spans(text)


def test_base_spans_are_linear_in_the_text():
    import time
    start = time.time()
    for text in ["1" * 100_000, "a" * 100_000 + "@", "+1" + " " * 100_000, "1." * 50_000, "a@" * 20_000, "1 " * 50_000, "0" * 6000 + ".1.1.1"]:
        pii.nodes_of(text)
    assert time.time() - start < 30


def test_field_adds_what_patterns_miss(spark, sf_dir):
    field = pii.fit(table(spark, "/root/testdata/sf0.01", "documents"))
    def found(text):
        return [(s["kind"], text[s["start"]:s["end"]], s["base"]) for s in pii.spans_of([text], field)[0]]
    assert found("Call +1 (652) 555-4544 now. Again 652-555-4544 then.") == [
        ("phone", "+1 (652) 555-4544", True), ("phone", "652-555-4544", False)]
    assert found("a.b@x.example.com, later a.b [at] x.example.com") == [
        ("email", "a.b@x.example.com", True), ("email", "a.b [at] x.example.com", False)]
    assert found("order 123456789 of 2024-01-15, 10.0.0.300, 4111 1111 1111 1112") == []
    bare = pii.train({}, {}, 0, 0)
    assert pii.spans_of(["652-555-4544 +1 652 555 4544", None], bare)[0] == [{"kind": "phone", "start": 13, "end": 28, "base": True}]


def test_any_run_of_digits_and_signs_is_read():
    rng = random.Random(3)
    assert pii.spans_of(["123).45.67.8"], pii.train({}, {}, 0, 0)) == [[]]
    for _ in range(30_000):
        pii.nodes_of("".join(rng.choice("0123456789 .-()+@a") for _ in range(rng.randrange(4, 24))))


def test_second_mentions_in_another_notation_are_found(spark):
    field = pii.fit(table(spark, "/root/testdata/sf0.01", "documents"))
    for kind, first, second in (("ip", "10.0.0.1", "10-0-0-1"), ("ip", "192.168.7.20", "192 168 7 20"), ("phone", "+1 652 555 4544", "652-555-4544"),
                                ("card", "4111 1111 1111 1111", "4111.1111.1111.1111"), ("email", "anna.b@mail.example.org", "Anna.B [at] mail.example.org")):
        text = f"Write to {first} today. Later they wrote {second} once more."
        found = [(s["kind"], text[s["start"]:s["end"]], s["base"]) for s in pii.spans_of([text], field)[0]]
        assert found == [(kind, first, True), (kind, second, False)], found


def test_messages_in_a_loop_come_near_exact_marginals():
    rng = np.random.default_rng(5)
    own = rng.normal(0, 1, (4, pii.LABELS))
    own[3] = 0                                        # the cluster variable that two tokens share, next to their chain
    left, right = np.array([0, 1, 0, 2]), np.array([1, 2, 3, 3])
    tables = np.stack([np.clip(rng.normal(0, 0.5, (pii.LABELS, pii.LABELS)), -1, 1) for _ in range(2)] + [np.eye(pii.LABELS) * 1.5] * 2)
    joint = np.zeros((pii.LABELS,) * 4)
    for place in np.ndindex(*joint.shape):
        joint[place] = np.exp(sum(own[i, place[i]] for i in range(4)) + sum(t[place[a], place[b]] for a, b, t in zip(left, right, tables)))
    joint /= joint.sum()
    exact = np.array([joint.sum(axis=tuple(j for j in range(4) if j != i)) for i in range(4)])
    assert np.abs(pii.beliefs(own, left, right, tables) - exact).max() < 0.03


def test_messages_equal_exact_marginals():
    import itertools

    import numpy as np
    r = np.random.default_rng(3)
    own, table_ = r.normal(size=(3, 5)), r.normal(size=(2, 5, 5))
    got = pii.beliefs(own, np.array([0, 1]), np.array([1, 2]), table_)
    exact = np.zeros((3, 5))
    for a in itertools.product(range(5), repeat=3):
        p = np.exp(sum(own[i, a[i]] for i in range(3)) + table_[0, a[0], a[1]] + table_[1, a[1], a[2]])
        for i in range(3):
            exact[i, a[i]] += p
    assert np.allclose(got, exact / exact.sum(axis=1, keepdims=True), atol=1e-3)


def test_pii_query_against_brute_force(spark, sf_dir):
    texts = dict(documents(spark, sf_dir).itertuples(index=False))
    found = pii.BOOK.queries["op3_skip_chain_pii"](spark, sf_dir).collect()
    assert len(found) == len(texts)
    for r in found:
        spans = brute_spans(texts[r.doc_id])
        text = ",".join(f"{pii.KINDS[k - 1]}:{a}:{b}" for a, b, k in spans)
        assert r.base_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == i for *_, k in spans) for i in (1, 2, 3, 4)]
        assert set(filter(None, text.split(","))) <= set(r.spans.split(","))


def test_pii_on_odd_rows(spark):
    docs = C.odd_documents(spark)
    field = pii.fit(docs)
    assert pii.find(docs, field).count() == len(C.rows())
    done = pii.mask(docs, field)
    assert done.columns == docs.columns
    assert pii.masked("x a@b.co y", [{"kind": "email", "start": 2, "end": 8}]) == "x [EMAIL] y"
    overlap = [{"kind": "ip", "start": 0, "end": 5}, {"kind": "card", "start": 3, "end": 9}]
    assert pii.masked("0123456789", overlap) == "[IP]9" and pii.masked(None, []) is None
    assert pii.mask(C.no_documents(spark), pii.fit(C.no_documents(spark))).count() == 0


# --- language -----------------------------------------------------------------------------------------
def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    found = language.BOOK.queries["op1_language_filters"](spark, sf).toPandas()
    truth = table(spark, sf, "documents").select("doc_id", "lang").toPandas()
    both = found.merge(truth, on="doc_id")
    assert len(found) == len(truth) and (found.held_out == [zlib.crc32(str(i).encode()) % 3 == 1 for i in found.doc_id]).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() > 0.99 and found.score.between(0, 1).all()


def test_filter_returns_all_languages_of_an_ngram():
    import numpy as np
    a, b = (np.unique(language.grams_of(language._points(t))) for t in ("alpha beta", "beta gamma"))
    f = language.build({"x": a, "y": b}, {"x": 1, "y": 1})
    total, found = language.counts(["beta", "alpha", "gamma", "", "Alpha! beta? " * 30_000], f)
    assert found[0].tolist() == [total[0]] * 2 and found[1][0] == total[1] > found[1][1] and found[2][1] == total[2] > found[2][0]
    assert total[3] == 0 and total[4] == 30_000 * (total[0] + total[1])     # slices are cut between words
    assert language.decide(["beta", "12 ?!", None, "ZZZZ"], f)[0] == ["x", "und", "und", "x"]


def test_more_than_64_languages():
    rng = np.random.default_rng(2)
    words = {f"l{i:03}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 8)) for _ in range(20)] for i in range(130)}
    grams = {k: np.unique(language.grams_of(language._points(" ".join(v)))) for k, v in words.items()}
    filters = language.build(grams, dict.fromkeys(words, 1))
    assert filters.masks.shape[0] == 3
    predicted, score = language.decide([" ".join(v) for v in words.values()], filters)
    assert predicted == sorted(words) and min(score) > 0.9


def test_language_on_odd_rows(spark):
    docs = C.odd_documents(spark)
    found = language.predict(docs, language.fit(docs)).collect()
    assert len(found) == len(C.rows())
    for r in found:
        assert (r.lang_pred == "und") == (not any(map(str.isalpha, r.text or ""))) and 0 <= r.score <= 1
    nothing = language.predict(docs, language.fit(C.no_documents(spark))).collect()
    assert {(r.lang_pred, r.score) for r in nothing} == {("und", 0.0)}
    assert language.predict(C.no_documents(spark), language.fit(docs)).count() == 0


def test_folds_and_samples(spark):
    df = spark.range(20000).withColumnRenamed("id", "doc_id")
    r = df.select("doc_id", id_fold("doc_id", 4).alias("f")).limit(50).collect()
    assert all(x.f == zlib.crc32(str(x.doc_id).encode()) % 4 for x in r)
    assert 800 < hash_sample(df, "doc_id", 1000, 20000).count() < 1200 and hash_sample(df, "doc_id", 30000, 20000).count() == 20000
