"""Whole operators against brute force, and rows that share ids or have none."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import chat, decontaminate, langid, packing, quality_classifier, quality_rules, runindex, simhash, suffix_dedup, token_binary, tokenizing, toxicity
from quotemill.session import ship
from tests.llm.test_operators import ODD, VOCABULARY, brute_components, labels, table

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def thue_morse(n: int, letters: str) -> str:
    return "".join(letters[bin(i).count("1") & 1] for i in range(n))


@pytest.mark.parametrize("special", [False, True])
@pytest.mark.parametrize("chunk", [40, 200_000])
def test_pieces_are_told_apart(monkeypatch, special, chunk):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = not special
    texts = [thue_morse(1024, "ab"), thue_morse(1024, "ba"), "hi <|endoftext|>'ll", "", ("one two it's " * 50).strip()]
    monkeypatch.setattr(tokenizing, "CHUNK", chunk)
    hashes = tokenizing._hashes
    for change in (hashes, lambda c, s, n: hashes(c, s, n) % np.uint64(3) << np.uint64(40)):  # the second one collides on purpose
        monkeypatch.setattr(tokenizing, "_hashes", change)
        ids, sizes = tokenizing.PieceEncoder(VOCABULARY, special)(texts)
        ends = np.cumsum(sizes)
        assert [ids[a:b].tolist() for a, b in zip(ends - sizes, ends, strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_packing_equals_the_library(spark):
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    rows = {i: t for i, t in enumerate([None, "", "abc", "word " * 3000, "ñ日😀 x", "abc"])}
    docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    ship(spark)
    ids = {i: [*plain.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows.items()}
    got = packing.pack(docs, VOCABULARY, with_ids=True).collect()
    for i, want in ids.items():
        pieces = sorted((r for r in got if r.doc_id == i), key=lambda r: r.start)
        assert [x for r in pieces for x in r.ids] == want and all(r.doc_tokens == len(want) for r in pieces)
    line = sorted(got, key=lambda r: (r.sequence_id, r.offset))
    assert [r.sequence_id * packing.SEQUENCE + r.offset for r in line] == list(np.cumsum([0, *(r.length for r in line)])[:-1])
    assert packing.pack(docs.where("false"), VOCABULARY).count() == 0


def test_blocks_hold_no_more_than_they_should(spark, tmp_path, monkeypatch):
    ship(spark)
    rows = [(7, "a b c d e f")] * 40 + [(None, "x y z")] * 30 + [(8, "long " * 200)]
    monkeypatch.setattr(token_binary, "BLOCK_IDS", 16)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    token_binary.write_token_files(docs, str(tmp_path / "t"), VOCABULARY)
    sizes = [r.n_ids for r in spark.read.parquet(str(tmp_path / "t" / "blocks")).collect()]
    assert sum(n > 16 for n in sizes) <= 1
    got = token_binary.read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    assert [r.doc_id for r in got] == [None] * 30 + [7] * 40 + [8]
    assert [r.start for r in got] == list(np.cumsum([0, *(r.n_tokens for r in got)])[:-1])
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)
    token_binary.write_token_files(docs.where("false"), str(tmp_path / "e"), VOCABULARY)
    assert token_binary.read_token_files(spark, str(tmp_path / "e")).count() == 0


def test_the_index_alone_finds_all_windows():
    rng = random.Random(3)
    base = [bytes(rng.choices(b"abcdefgh ", k=160)) for _ in range(120)]
    strings = []
    for _ in range(1500):
        s = bytearray(rng.choice(base)[rng.randint(0, 20) :])
        s[rng.randint(0, len(s) - 1)] = 33
        strings.append(bytes(s))
    index = runindex.RunIndex(strings)
    assert not hasattr(index, "order") and len(index.run_bytes) < len(index.text) / 2
    at, group = index.repeated(suffix_dedup.WIDTH)
    text, room, want = index.text.tobytes(), index.room, {}
    for i in np.flatnonzero(room >= suffix_dedup.WIDTH).tolist():
        want.setdefault(text[i : i + suffix_dedup.WIDTH], []).append(i)
    got: dict = {}
    for i, g in zip(at.tolist(), group.tolist(), strict=True):
        got.setdefault(g, []).append(i)
    assert sorted(got.values()) == sorted(v for v in want.values() if len(v) > 1)


def test_long_texts_are_scanned_in_blocks(monkeypatch):
    rng = random.Random(4)
    text = bytes(rng.choices(b"abcd ", k=3000))
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    first, last, *_ = suffix_dedup.stretches(text)
    assert first[0] == 0 and last[-1] == 2900 and (first[1:] == last[:-1] + 1).all()


def brute_fingerprint(text):
    import xxhash

    raw = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())
    words = raw.split()
    grams = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def test_simhash_components_equal_brute_force(spark):
    ship(spark)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdeFGH", k=4))
    rows = [(None, ""), (None, None), (3, " \n"), (None, "only here alone"), (None, "only here alone")]
    for k in range(40):
        base = [word() for _ in range(120)]
        for j in range(rng.randint(1, 3)):
            copy = list(base)
            if j:
                copy[rng.randint(0, 119)] = word()
            rows.append((None if rng.random() < 0.3 else 100 + 5 * k + j, " ".join(copy)))
    fps = [brute_fingerprint(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= 3:
                up[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    want = sorted(str((d, f"{f:016x}", least.get(find(k)))) for k, ((d, _), f) in enumerate(zip(rows, fps, strict=True)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(str((r.doc_id, r.fingerprint, r.component_id)) for r in simhash.near_duplicates(docs).collect()) == want


def test_automaton_equals_edit_distance():
    rng = random.Random(2)
    terms = {"".join(rng.choices("abc", k=rng.randint(4, 7))): rng.random() for _ in range(40)}
    auto = toxicity.LexiconAutomaton(terms)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a):
            new = [i + 1]
            for j, y in enumerate(b):
                new.append(min(row[j] + (x != y), row[j + 1] + 1, new[-1] + 1))
            row = new
        return row[-1]

    for _ in range(800):
        w = "".join(rng.choices("abc", k=rng.randint(2, 8)))
        near = [(distance(w, t), -v) for t, v in terms.items()]
        near = [x for (x, t) in zip(near, terms, strict=True) if x[0] == 0 or x[0] == 1 and len(t) >= toxicity.FUZZY]
        found = auto.match(w)
        assert (found and (found[1], -found[0])) == (min(near) if near else None)


def test_a_text_with_both_labels_is_toxic(spark):
    ship(spark)
    rows = [(i, f"you are a glorpnak fool number {i}") for i in range(8)] + [(100 + i, f"a calm clean text of number {i}") for i in range(8)] + [(200, "you are a glorpnak fool number 0")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    given = [(i, 1, 1) for i in range(8)] + [(100 + i, 1, 0) for i in range(8)] + [(200, 1, 0)]
    runs = [toxicity.train(docs.repartition(n), labels(spark, given)) for n in (1, 4)]
    assert runs[0] == runs[1] and "glorpnak" in runs[0][0]


def test_spaced_seeds_do_not_depend_on_other_items_or_rows(spark):
    ship(spark)
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu".split()
    other = " ".join([*item[:7], *"q w e r t y u i o p".split()])
    rows = [(1, "x " + " ".join(item) + " y"), (1, other), (None, " ".join(item)), (2, "yes"), (3, "yes no"), (4, " ".join(item[:6])), (5, "one two three four five seven")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = set()
    for more in ([], [(1, "a b c d e")]):
        for n in (1, 3):
            items = spark.createDataFrame([(0, " ".join(item)), (7, "Yes"), (8, "one two three four five six"), (9, None), *more], "item_id long, text string")
            got.add(tuple(sorted(map(str, map(tuple, decontaminate.contaminated(docs.repartition(n), items).collect())))))
    assert len(got) == 1
    pairs = sorted(str(eval(r)[:2]) for r in got.pop())
    assert pairs == sorted(map(str, [(1, 0), (None, 0), (2, 7), (5, 8)]))
    kept = decontaminate.decontaminated(docs, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string"))
    assert sorted(r.text for r in kept.collect()) == sorted(t for d, t in rows if t not in (rows[0][1], rows[2][1]))


def test_co_training_teaches_what_labels_do_not(spark):
    """The words of unlabelled good pages are learnt only through the page's view."""
    ship(spark)
    rng = random.Random(1)
    say = lambda words, n=30: " ".join(rng.choices(words, k=n))
    common_, new_good, new_bad = "the and of in".split(), "vintara melodo".split(), "grubbel snorty".split()
    rows, given = [], []
    for i in range(60):
        good = i % 2
        rows.append((i, say(common_ + (["fine"] if good else ["poor"])), "en", "good.org" if good else "bad.org", 200))
        given.append((i, good, 0))
    for i in range(200):
        good = i % 2
        rows.append((1000 + i, say(common_ + (new_good if good else new_bad)), "en", "good.org" if good else "bad.org", 200))
    tests = [(5000 + k, say(common_ + (new_good if k % 2 else new_bad)), None, None, None) for k in range(20)]
    docs = spark.createDataFrame(rows + tests, COLUMNS)
    right = {}
    for rounds in (0, 2):
        model = quality_classifier.train(docs.where("doc_id < 5000"), labels(spark, given), None, rounds)
        got = {r.doc_id: r.text_score for r in quality_classifier.score(docs, model).where("doc_id >= 5000").collect()}
        right[rounds] = min(got[k] for k in got if k % 2) - max(got[k] for k in got if not k % 2)
    assert right[2] > 0 and right[2] > right[0] + 0.1


def test_documents_of_two_languages(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = langid.train(docs)
    texts = {r.lang: r.text for r in docs.where("length(text) > 1500 and lang is not null").groupBy("lang").agg(F.min("text").alias("text")).collect()}
    (a, x), (b, y) = sorted(texts.items())[:2]
    mixed = spark.createDataFrame([(1, x[:1500] + " " + y[:800]), (2, x), (3, None), (4, "123 --")], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(mixed, *model).collect()}
    assert got[1].languages[:2] == [a, b] and got[1].lang_pred == a and got[1].shares[0] > got[1].shares[1] > 0.15
    assert got[2].languages[0] == a and [got[k].lang_pred for k in (3, 4)] == ["und", "und"] and got[3].languages == []


def brute_mixture(like, counts, allowed):
    share = np.array(allowed, float) / sum(allowed)
    for _ in range(langid.ROUNDS):
        new = np.zeros(len(share))
        for row, n in zip(like, counts, strict=True):
            p = np.exp(row) * share
            new += n * p / p.sum()
        share = new / sum(counts)
    return share, sum(n * np.log((np.exp(row) * share).sum()) for row, n in zip(like, counts, strict=True))


def test_mixtures_equal_brute_force():
    rng = np.random.default_rng(3)
    for _ in range(20):
        counts = rng.integers(1, 9, 25)
        like = np.log(rng.dirichlet(np.ones(4) * 0.3, 25) + 1e-3)
        share, _ = langid.infer(like, np.array([0]), counts)
        single = (like * counts[:, None]).sum(axis=0)
        penalty = langid.PENALTY * np.log(counts.sum() + 1)
        full, total = brute_mixture(like, counts, [1] * 4)
        best, want = single.max(), np.eye(4)[single.argmax()]
        for size in (2, 3, 4):
            if total - penalty * (size - 1) <= best:
                break
            part, fit = brute_mixture(like, counts, [float(k in np.argsort(-full, kind="stable")[:size]) for k in range(4)])
            if fit - penalty * (size - 1) > best:
                best, want = fit - penalty * (size - 1), part
        assert np.allclose(share[0], want, atol=1e-6)


def test_chat_of_all_parts_and_odd_rows(spark):
    part = lambda *x: [tuple(x)]
    rows = [(1, 0, "user", [("image", None, "i", 2.0), ("AUDIO", None, "a", 3.0), ("document", None, "d", None), ("video", None, "v", 1.0), ("text", "<|image|> \\", None, None), (None, "plain", None, None)]), (1, 1, "assistant", part("text", "[INST]|", None, None)), (1, 1, "assistant", part("text", "[INST]|", None, None)), (2, None, None, None), (2, 0, "assistant", part("text", "", None, None))]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PART}").withColumn("formatted", F.lit("x")).withColumn("_at", F.lit(1))
    got = {r.conv_id: r for r in chat.read_turns(chat.format_chats(turns)).withColumn("lost", chat.loss_text(F.col("formatted"), F.col("loss_mask"))).collect()}
    one = got[1]
    assert [(a.part, a.type, a.ref, a.tokens) for a in one.attachments] == [(0, "image", "i", 425), (1, "audio", "a", 79), (2, "document", "d", 2), (3, "document", "v", 514)]
    assert one.attachment_tokens == 425 + 79 + 2 + 514 and one.lost == "[INST]|" * 2
    assert [t.text for t in one.turns] == ["<|image|> \\plain", "[INST]|", "[INST]|"]
    assert [(t.role, t.text) for t in got[2].turns] == [("", ""), ("assistant", "")] and got[2].lost == ""
    assert chat.format_chats(turns.where("false")).count() == 0


def test_stages_take_odd_rows_and_empty_tables(spark, tmp_path):
    import corpus_pipeline as p

    sf = str(tmp_path)
    labels(spark, [(4, 1, 1), (None, 1, 0)]).write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame([(1, "a b c d e f g")], "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    odd = table(spark)
    ship(spark)
    for name, stage in p.STAGES:
        got = stage(spark, odd, sf)
        if name != "packing":
            assert got.columns == p.COLUMNS
            assert stage(spark, odd.where("false"), sf).count() == 0
        else:
            assert sum(r.length for r in got.collect()) == sum(len(r.ids) for r in got.collect()) and got.where("ids is null").count() == 0
    kept = p.near_duplicate(spark, odd, sf).collect()
    assert len(kept) == len(set(brute_components([(i, r[1]) for i, r in enumerate(ODD)])))
    assert [r.doc_id for r in p.decontamination(spark, odd, sf).collect()].count(None) == 0


def test_toxicity_stage_drops_what_the_score_says(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    bad = {r.doc_id for r in toxicity.score(docs, *toxicity.train(docs, spark.read.parquet(f"{sf}/labels.parquet"))).where("score >= 0.5").collect()}
    assert {r.doc_id for r in p.toxicity(spark, docs, sf).collect()} == {r.doc_id for r in docs.collect()} - bad


def test_quality_rules_of_many_texts(spark):
    ship(spark)
    rng = random.Random(8)
    rows = [(i, "\n".join(" ".join(rng.choices(["a", "bb", "#", "$x", "é"], k=rng.randint(0, 9))) for _ in range(rng.randint(1, 6)))) for i in range(60)]
    got = {r.doc_id: r for r in quality_rules.line_quality(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = t.split()
        wins = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
        hit = {k + j for k, x in enumerate(wins) if wins.count(x) > 1 for j in range(5)}
        lines = [x for x in t.split("\n") if x.strip()]
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))
        assert r.base_failed == (len(w) < 10 or 100 * len(hit) > 20 * len(w))
