"""The operators against brute force, round trips and edge cases, on small tables."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quotemill.llm import chat, decontaminate, langid, near_copies, packing, quality_classifier, quality_rules, simhash, suffix_dedup, token_binary, toxicity
from quotemill.llm.runindex import RunIndex
from quotemill.llm.tokenizing import encoder, vocabulary_path
from quotemill.session import ship

VOCABULARY = vocabulary_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp string, _at int"
#: Nulls, empty and blank texts, ties, repeated rows, a long text, and columns whose names the operators use.
ODD = [(1, None, None, None, None, 1.0, "x", 1), (2, "", "en", "s", 0, 1.0, "x", 1), (3, " \n\t ", "en", "s", 4, 1.0, "x", 1), (4, "one two", "en", None, 7, 1.0, "x", 1), (4, "one two", "en", None, 7, 1.0, "x", 1), (None, "a b c d e f g", None, "s", 13, 1.0, "x", 1), (5, "été ½ 日本 😀 " * 2000, "fr", "s", 1, 1.0, "x", 1)]


def table(spark, rows=ODD):
    ship(spark)
    return spark.createDataFrame(rows, SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "toxicity": lambda s, d: toxicity.score(d, *toxicity.train(d, labels(s, [(4, 1, 1), (None, 1, 0), (2, None, None)]))),
    "quality_rules": lambda s, d: quality_rules.line_quality(d),
    "quality_classifier": lambda s, d: quality_classifier.score(d, quality_classifier.train(d, labels(s, [(4, 1, 0), (2, 0, 0), (3, None, None)]))),
    "suffix_dedup": lambda s, d: suffix_dedup.remove_repeats(d, with_text=True),
    "langid": lambda s, d: langid.identify(d, *langid.train(d)),
    "simhash": lambda s, d: simhash.near_duplicates(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_and_empty_tables(spark, name):
    got = OPERATORS[name](spark, table(spark)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ODD)
    assert OPERATORS[name](spark, table(spark, [])).count() == 0


def test_decontamination_of_odd_rows(spark):
    items = spark.createDataFrame([(1, "a b c d e f g"), (2, None), (3, "x")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(table(spark), items).collect()] == [(None, 1)]
    assert decontaminate.contaminated(table(spark, []), items).count() == 0
    assert decontaminate.contaminated(table(spark), items.where("false")).count() == 0


def test_decontamination_takes_two_replaced_words(spark):
    ship(spark)
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    item = [word() for _ in range(13)]
    rows = []
    for i in range(13):
        for j in range(i):
            rows.append((len(rows), [word() for _ in range(5)] + [word() if k in (i, j) else w for k, w in enumerate(item)] + [word() for _ in range(5)]))
    docs = spark.createDataFrame([(k, " ".join(w)) for k, w in rows] + [(999, " ".join(word() for _ in range(60)))], "doc_id long, text string")
    got = {r.doc_id for r in decontaminate.contaminated(docs, spark.createDataFrame([(0, " ".join(item))], "item_id long, text string")).collect()}
    assert got == {k for k, _ in rows}


def test_tokenizing_equals_the_library():
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(VOCABULARY)
    plain.encode_special_tokens = True
    rng = random.Random(1)
    texts = ["".join(rng.choices("ab  \n\t'strevmld S1٣½²é日!?-_　\x1c\x85́😀\x00", k=rng.randint(0, 40))) for _ in range(3000)] + ["<|endoftext|> 'll", None]
    ids, sizes = encoder(VOCABULARY)(texts)
    ends = np.cumsum(sizes)
    for t, a, b in zip(texts, ends - sizes, ends, strict=True):
        assert ids[a:b].tolist() == plain.encode(t or "", add_special_tokens=False).ids


def test_token_files_round_trip(spark, tmp_path):
    ranks = np.array([0, 255, 256, 65535, 65536, 2**24, 2**32 - 1, 7, 1], np.uint32)
    assert (token_binary.decode_ranks(*token_binary.encode_ranks(ranks), len(ranks)) == ranks).all()
    token_binary.write_token_files(table(spark), str(tmp_path / "t"), VOCABULARY)
    got = token_binary.read_token_files(spark, str(tmp_path / "t"), with_ids=True).orderBy("start").collect()
    at = 0
    for r, row in zip(got, sorted(ODD, key=lambda x: (x[0] is not None, x[0] or 0)), strict=True):
        want = [*encoder(VOCABULARY)([row[1]])[0].tolist(), 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids, r.ids_crc32) == (row[0], at, len(want), want, zlib.crc32(np.array(want, "<u4").tobytes()))
        at += len(want)


def test_packing_places_each_id_once(spark):
    got = packing.pack(table(spark), VOCABULARY, with_ids=True).collect()
    total = sum(len(encoder(VOCABULARY)([r[1]])[0]) + 1 for r in ODD)
    assert sum(r.length for r in got) == total
    at = sorted((r.sequence_id, r.offset, r.length) for r in got)
    assert [s * packing.SEQUENCE + o for s, o, _ in at] == list(np.cumsum([0, *(n for *_, n in at)])[:-1])
    assert all(r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) for r in got)


def test_hilbert_keys_walk_the_grid():
    grid = np.array([(x, y, z) for x in range(4) for y in range(4) for z in range(4)])
    keys = packing.hilbert_keys(grid, 2)
    walk = grid[np.argsort(keys)]
    assert sorted(keys) == list(range(64)) and (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_run_index_matches_brute_force():
    rng = random.Random(5)
    for _ in range(30):
        strings = ["".join(rng.choices("ab", k=rng.randint(1, 60))).encode() for _ in range(rng.randint(1, 6))]
        index, text = RunIndex(strings), b"".join(strings)
        _, best = index.matching_statistics()
        suffix = [text[i : i + index.room[i]] for i in range(len(text))]
        common = lambda a, b: next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert best.tolist() == [max((common(suffix[i], suffix[j]) for j in range(len(text)) if j != i), default=0) for i in range(len(text))]
        assert (np.repeat(index.run_bytes, index.run_sizes)[index.run_bytes.repeat(index.run_sizes) >= 0] < 256).all()


def brute_repeats(texts, width):
    seen, out = set(), []
    for t in texts:
        raw = (t or "").encode()
        stay = np.ones(len(raw), bool)
        for i in range(len(raw) - width + 1):
            if raw[i : i + width] in seen:
                stay[i : i + width] = False
            seen.add(raw[i : i + width])
        edge = np.concatenate([[True], stay, [True]])
        out.append((len(raw), int((~stay).sum()), int((edge[:-1] & ~edge[1:]).sum()), hashlib.sha256(np.frombuffer(raw, np.uint8)[stay].tobytes()).hexdigest()))
    return out


@pytest.mark.parametrize("group", [3, 4000])
def test_suffix_dedup_equals_brute_force(spark, monkeypatch, group):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (suffix_dedup.WIDTH, suffix_dedup.SEED, group))
    ship(spark)
    rng = random.Random(9)
    part = lambda n, letters="abcdé ": "".join(rng.choices(letters, k=n))
    shared = [part(rng.randint(90, 400)) for _ in range(6)]
    texts = []
    for _ in range(60):
        texts.append("".join(x for _ in range(rng.randint(1, 4)) for x in (part(rng.randint(0, 150)), rng.choice(shared)[rng.randint(0, 60) :])))
    texts += [texts[3], texts[3], "a" * 500, "ab" * 300, None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.remove_repeats(docs).collect()}
    assert got == dict(enumerate(brute_repeats(texts, suffix_dedup.WIDTH)))


def test_suffix_dedup_of_one_document_with_a_crowded_phrase(spark, monkeypatch):
    group = 16
    monkeypatch.setattr(suffix_dedup.repeated_spans, "__defaults__", (suffix_dedup.WIDTH, suffix_dedup.SEED, group))
    ship(spark)
    rng = random.Random(12)
    part = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    phrase, sides = part(40), [part(90) for _ in range(12)]
    text = "".join(x for _ in range(400) for x in (rng.choice(sides)[rng.randint(0, 30) :], phrase, rng.choice(sides)[: rng.randint(50, 90)], part(rng.randint(0, 9))))
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = suffix_dedup.remove_repeats(docs).first()
    assert [(r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)] == brute_repeats([text], suffix_dedup.WIDTH)
    group_, ord_, start = np.array([1, 1, 2, 1]), np.zeros(4, np.int64), np.array([9, 4, 5, 6])
    assert suffix_dedup._firsts(group_, ord_, start).tolist() == [False, True, True, False]


@pytest.mark.parametrize("block", [2, 4096])
def test_linked_fingerprints_equal_brute_force(spark, block):
    ship(spark)
    rng = random.Random(2)
    fps = []
    for _ in range(40):
        base = rng.getrandbits(64)
        fps += [base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))) for _ in range(rng.randint(1, 8))]
    fps = sorted(set(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.linked_fingerprints(spark.createDataFrame([(x,) for x in signed], "fp long"), block=block).collect()

    def classes(edges):
        up = {x: x for x in signed}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in edges:
            up[find(a)] = find(b)
        return sorted(sorted(x for x in signed if find(x) == r) for r in set(map(find, signed)))

    near = [(a, b) for i, a in enumerate(signed) for b in signed[:i] if bin((a ^ b) & (1 << 64) - 1).count("1") <= 3]
    assert classes([(r.a, r.b) for r in links]) == classes(near)


def test_thresholds_keep_the_pigeonhole():
    sample = np.random.default_rng(1).integers(0, 1 << 63, 500).astype(np.uint64)
    for total in (100, 10**5, 10**9):
        parts = simhash.plan(sample, total)
        assert sum(t + 1 for _, t in parts) == simhash.DISTANCE + 1
        masks = [m for m, _ in parts]
        assert all(a & b == 0 for i, a in enumerate(masks) for b in masks[:i])


def test_automaton_takes_one_error():
    auto = toxicity.LexiconAutomaton({"idiot": 3.0, "scum": 2.0})
    assert auto.match("idiot") == (3.0, 0) and auto.match("scum") == (2.0, 0)
    for word in ("id1ot", "idot", "idiott", "xidiot", "diot"):
        assert auto.match(word) == (3.0, 1), word
    assert auto.match("idxxt") is None and auto.match("scun") is None


def test_quotation_scores_below_abuse():
    s = toxicity.Scorer({"idiot": 3.0})
    w = np.array(toxicity.DEFAULT)
    assert np.dot(w, s.features("you are an idiot my friend")) > np.dot(w, s.features('she said "idiot" is a rude word'))


def test_scores_do_not_depend_on_the_word_cache(monkeypatch):
    texts = ["you are an idiot", "some clean words here", "you idiot again", "more of it", "an idiot said you", "idiot"] * 2
    alone = [toxicity.Scorer({"idiot": 3.0}).features(t) for t in texts]
    for size in range(12):
        monkeypatch.setattr(toxicity, "KNOWN_WORDS", size)
        s = toxicity.Scorer({"idiot": 3.0})
        assert [s.features(t) for t in texts] == alone


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = langid.langid_query(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.98
    truth = spark.read.parquet(f"{sf}/labels.parquet")
    good = quality_classifier.quality_query(spark, sf).join(truth, "doc_id").where("held_out")
    assert good.select(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.9
    toxic = toxicity.toxicity_query(spark, sf).join(truth, "doc_id").where("held_out")
    assert toxic.select(F.avg((F.col("toxic") == F.col("predicted")).cast("double"))).first()[0] > 0.85


def test_language_shares_of_a_mixture():
    like = np.log(np.array([[0.9, 0.05, 0.05]] * 60 + [[0.05, 0.9, 0.05]] * 40, np.float32))
    share, _ = langid.infer(like, np.array([0]))
    assert share.argmax() == 0 and 0.2 < share[0, 1] < 0.6 and share[0, 2] < 0.01


def test_chat_parts(spark):
    rows = [(1, 0, "user", [("text", "see </s> \\ <|end|>", None, None), ("image", None, "img-1", 2.0), ("text", "[INST]", None, None)]), (1, 1, "assistant", [("text", "ok|>", None, None)]), (None, None, None, [("text", None, None, None)])]
    turns = spark.createDataFrame(rows, f"conv_id long, turn long, role string, content {chat.PART}")
    back = {r.conv_id: r for r in chat.read_turns(chat.format_chats(turns)).collect()}
    r = back[1]
    assert [(t.role, t.text, t.loss) for t in r.turns] == [("user", "see </s> \\ <|end|>[INST]", False), ("assistant", "ok|>", True)]
    assert [(a.turn, a.part, a.type, a.ref, a.tokens) for a in r.attachments] == [(1, 1, "image", "img-1", 425)] and r.attachment_tokens == 425
    span = r.loss_mask[1]
    assert r.formatted[span.start : span.start + span.length] == "ok|\\>"
    assert "</s>" not in r.formatted and "[INST]" not in r.formatted
    assert [(t.role, t.text) for t in back[None].turns] == [("", "")]


def test_quality_counts(spark):
    text = "a b c d e f a b c d e\nx y\n\nx y\nq # $"
    r = quality_rules.line_quality(table(spark, [(1, text, None, None, None, None, None, None)])).first()
    assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (18, 18, 2, 1, 10)


def test_pipeline_stages_keep_clean_documents(spark):
    import corpus_pipeline as p

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    near = p.near_duplicate(spark, docs, sf)
    assert near.columns == p.COLUMNS
    assert {r.doc_id for r in near.collect()} == set(brute_components([(r.doc_id, r.text) for r in docs.collect()]))
    clean = p.decontamination(spark, docs, sf)
    gone = {r.doc_id for r in decontaminate.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
    assert {r.doc_id for r in clean.collect()} == {r.doc_id for r in docs.collect()} - gone
    assert p.repeated_strings(spark, docs, sf).count() == docs.count()


def test_repeated_strings_keeps_the_first_of_rows_that_share_an_id(spark):
    import corpus_pipeline as p

    rng = random.Random(4)
    part = lambda n: "".join(rng.choices("abcdefgh ", k=n))
    x, y = part(300), part(250)
    # Rows of one id: equal texts, equal lengths and differing texts; null ids; a row that loses nothing.
    rows = [(7, x, "de", "s", 300), (7, x, "en", "s", None), (7, x, "en", "t", 300), (8, part(50) + x[:200], "en", "s", 250), (8, y[:200] + part(50), "en", "s", 250), (8, y, "en", "s", 250), (None, part(40) + y[50:200], "en", "s", 190), (None, y[60:220], None, None, 160), (9, part(400), "en", "s", 1)]
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or "", r[3] or "", r[4] or 0))
    seen, want = set(), []
    for doc_id, text, lang, source, n_chars in order:
        stay = [True] * len(text)
        for i in range(len(text) - suffix_dedup.WIDTH + 1):
            if (w := text[i : i + suffix_dedup.WIDTH]) in seen:
                stay[i : i + suffix_dedup.WIDTH] = [False] * suffix_dedup.WIDTH
            seen.add(w)
        kept = "".join(c for c, s in zip(text, stay, strict=True) if s)
        want.append((doc_id, kept, lang, source, n_chars if all(stay) else len(kept)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = p.repeated_strings(spark, docs.repartition(3), "").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert sum(r.text == x for r in got) == 1


def brute_components(rows):
    """Component of each (doc_id, text) by the similarity of its five-word shingles: the least id, where there is one."""
    sets = []
    for _, t in rows:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]):
                up[find(i)] = find(j)
    least = {}
    for k, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[find(k)] = min(doc_id, least.get(find(k), doc_id))
    return [least.get(find(k)) for k in range(len(rows))]


@pytest.mark.parametrize("block", [2, 4096])
def test_near_copies_equal_brute_force(spark, block):
    ship(spark)
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    passage, texts = [word() for _ in range(40)], [None, "", " \n", "one two", "One  two", "one"]
    for _ in range(25):
        base = [word() for _ in range(rng.randint(6, 200))]
        for _ in range(rng.randint(1, 5)):
            copy = list(base)
            for at in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 30))):
                copy[at] = word()
            texts.append(" ".join(copy + (passage if rng.random() < 0.2 else [])))
    texts += [" ".join([*passage, word(), word()]) for _ in range(12)]
    rows = [(k if k % 9 else None, t) for k, t in enumerate(texts)]
    want = sorted((str(doc_id), str(c)) for (doc_id, _), c in zip(rows, brute_components(rows), strict=True))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted((str(r.doc_id), str(r.component_id)) for r in near_copies.near_copies(docs, block).collect()) == want
    assert near_copies.near_copies(docs.where("false")).count() == 0


def test_pipeline_takes_near_copies_more_than_three_bits_apart(spark):
    import corpus_pipeline as p

    rng = random.Random(8)
    words = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(152)]
    docs = []
    for k in range(20):
        copy = list(words)
        copy[7 * k] = "other"
        docs.append((k, " ".join(copy), "en", "s", 1))
    apart = {bin(simhash.fingerprint(t) ^ simhash.fingerprint(docs[0][1])).count("1") for _, t, *_ in docs}
    assert max(apart) > simhash.DISTANCE
    near = p.near_duplicate(spark, spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long"), "")
    assert [r.doc_id for r in near.collect()] == [0]


def test_pipeline_takes_what_simhash_links_below_the_similarity(spark):
    import corpus_pipeline as p

    def moved(seed):
        rng = random.Random(seed)
        lines = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(6)) for _ in range(60)]
        copy = list(lines)
        for _ in range(5):
            copy.insert(rng.randrange(60), copy.pop(rng.randrange(60)))
        return "\n".join(lines), "\n".join(copy)

    def only_simhash(one, two):
        a, b = (near_copies.shingles(t).tobytes() for t in (one, two))
        return bin(simhash.fingerprint(one) ^ simhash.fingerprint(two)).count("1") <= simhash.DISTANCE and not near_copies._similar(a, b)

    one, two = next(x for x in map(moved, range(2000)) if only_simhash(*x))
    docs = spark.createDataFrame([(5, two, "en", "s", 1), (4, one, "en", "s", 1), (6, "another text", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in p.near_duplicate(spark, docs, "").collect()) == [4, 6]
