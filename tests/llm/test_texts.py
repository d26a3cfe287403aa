"""Tokens, pieces, language, quality, leaks, URLs and archives."""

import base64
import gzip
import hashlib
from pathlib import Path

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from molq.llm import lang_id, pieces, quality_fm, queries, token_counts
from molq.llm.decontaminate import drop_leaks, find_leaks
from molq.llm.merges import StablePairs
from molq.llm.url_filter import filter_urls, split_url
from molq.llm.warc import parse_record, read_archives, read_members, write_archives

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not Path(SF).exists(), reason="supplied tables are absent")
ODD = ["", "   ", "don't we'RE 'll''t x'r 12 ３ Ünïcödé ΣΑΣ", "a<|startoftext|>b<|end <|endoftext|>", "日本語 テキスト😀!!", "é İstanbul ﬁ",
       "''re'", "\x1c\x85 a b", "x" * 3000, "<s> <0x41> ▁x ▁▁", "1234567", "....,,;;!!??---===", "\0 x", "\n\n\tworld  "]


def test_stable_pairs_agree_with_merging():
    order = {("a", "b"): 0, ("ab", "c"): 1, ("c", "a"): 2, ("b", "c"): 3, ("a", "a"): 4, ("aa", "a"): 5, ("ca", "b"): 6}
    pairs = StablePairs(lambda a, b: order.get((a, b)), list)
    tokens = ["a", "b", "c", "ab", "abc", "ca", "bc", "aa", "aaa", "cab"]
    for left in tokens:
        for right in tokens:
            assert pairs[left, right] == (pairs.encode(list(left + right)) == [left, right]), (left, right)


def test_token_counts_match_the_library(frame):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(0, "again"), (None, "word")]
    tool = Tokenizer.from_file(token_counts.VOCABULARY)
    data = frame([(*r, "x") for r in rows], "dataset bigint, provenance string, n_tokens string")
    got = token_counts.token_counts(data, limit=4).collect()
    assert len(got) == len(rows)
    for (i, t), r in zip(rows, got, strict=True):
        want = len(tool.encode(t or "", add_special_tokens=False).ids)
        assert (r.dataset, r.n_bytes, r.n_tokens, r.over_limit) == (i, len((t or "").encode()), want, want > 4), t
    assert token_counts.token_counts(frame([], "dataset string, provenance string")).collect() == []


def test_every_prefix_against_the_library():
    tool = Tokenizer.from_file(token_counts.VOCABULARY)
    counter = token_counts.PrefixCounter(token_counts.VOCABULARY)
    texts = ["", " ", "\t\v a\r\n\fb ", "it's 'll 'vex !'s can't'", "q" * 70 + "-" * 70 + "é1" * 40, "жук 12<|endoftext|>'re…  x", "a\u00a0b\u2003c\x1cd"]
    for text in [*texts, *texts[::-1]]:
        shown = counter.normal(text)
        assert counter.prefixes(text).tolist() == [len(tool.encode(shown[:k], add_special_tokens=False).ids) for k in range(len(shown) + 1)], text


def test_longest_prefix_within_the_limit(frame):
    rows = [(1, "one two three four"), (2, "one"), (3, ""), (4, None)]
    got = token_counts.token_counts(frame(rows, "dataset int, provenance string"), limit=2).collect()
    assert [(r.n_tokens, r.over_limit, r.chars_within) for r in got] == [(4, True, 8), (1, False, 3), (0, False, 0), (0, False, 0)]
    assert {r.chars_within for r in token_counts.token_counts(frame(rows, "dataset int, provenance string"), limit=-1).collect()} == {-1}


def test_prefix_tables_answer_cuts_and_budgets(frame):
    tool = Tokenizer.from_file(token_counts.VOCABULARY)
    count = lambda s: len(tool.encode(s, add_special_tokens=False).ids)
    text = "the quick brown foxes' won't jump, 42 times <|endoftext|> over… été"
    got = token_counts.token_counts(frame([("d", text)], "dataset string, provenance string"), keep_prefixes=True)
    table = np.frombuffer(got.first().prefix_tokens, np.int32)
    assert table.tolist() == [count(text[:k]) for k in range(len(text) + 1)]
    row = got.select(token_counts.tokens_at("prefix_tokens", F.lit(9)).alias("at"), token_counts.tokens_at("prefix_tokens", F.lit(999)).alias("off"),
                     token_counts.longest_within("prefix_tokens", F.lit(6)).alias("fit"), token_counts.longest_within("prefix_tokens", F.lit(-1)).alias("none")).first()
    assert (row.at, row.off, row.fit, row.none) == (count(text[:9]), None, max(k for k in range(len(text) + 1) if count(text[:k]) <= 6), -1)


def test_pieces_match_the_library(frame):
    rows = [(i, t) for i, t in enumerate([*ODD, None])] + [(0, "again"), (None, "word")]
    tool = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    data = frame([(*r, 1) for r in rows], "dataset bigint, provenance string, piece_ids int")
    for r, (i, t) in zip(pieces.encode_and_decode(data).collect(), rows, strict=True):
        want = tool.encode(t or "")
        assert (r.dataset, r.piece_ids, r.decoded) == (i, want, tool.decode(want)), t
    coded = pieces.encode_pieces(data)
    assert pieces.decode_pieces(coded).count() == len(rows)
    lists = frame([(1, None), (2, []), (3, [1, 2, 3 + 0x41])], "dataset int, piece_ids array<int>")
    assert [r.decoded for r in pieces.decode_pieces(lists).collect()] == ["", "", "A"]
    assert pieces.encode_and_decode(frame([], "dataset int, provenance string")).collect() == []


@needs_tables
def test_pieces_and_tokens_of_whole_documents(spark):
    texts = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    coder = pieces.PieceTransducer(pieces.MODEL)
    tool = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    assert [coder.encode(t).tolist() for t in texts] == tool.encode(texts)
    counter, library = token_counts.PrefixCounter(token_counts.VOCABULARY), Tokenizer.from_file(token_counts.VOCABULARY)
    assert [int(counter.prefixes(t)[-1]) for t in texts] == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]


@needs_tables
def test_language_of_held_out_documents(spark):
    got = queries.QUERIES["op9_language_id"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    held = got.where("held_out").toPandas()
    assert len(held) > 20 and (held.lang == held.lang_pred).mean() > 0.97 and held.score.between(0, 1).all()


def test_language_edges(frame):
    rows = [(1, "the cat and the dog sat on the mat", "en"), (2, "le chat et le chien sont sur le tapis", "fr"), (3, None, "en"), (4, "12 !!", "fr"),
            (None, "the dog", "en"), (1, "the cat and the dog sat on the mat", "en"), (5, "the mat", None)]
    data = frame(rows, "dataset bigint, provenance string, lang string")
    model = lang_id.fit_language_centroids(data)
    got = lang_id.predict_language(frame([(*r, 1) for r in rows] + [(6, "жук", None, 1), (7, "", None, 1), (8, "the cat " * 40000, None, 1)],
                                         "dataset bigint, provenance string, lang string, score int"), model).collect()
    assert [r.lang_pred for r in got] == ["en", "fr", "und", "und", "en", "en", "en", got[7].lang_pred, "und", "en"]
    assert [r.rejected for r in got] == [False, False, True, True, False, False, False, True, True, False]
    assert got[7].lang_pred in ("en", "fr") and got[2].score == 0
    assert sorted(r.dataset or 0 for r in lang_id.drop_rejected(data, model).collect()) == [0, 1, 1, 2, 5]
    assert lang_id.predict_language(data.limit(0), model).collect() == []
    with pytest.raises(ValueError):
        lang_id.fit_language_centroids(data.limit(0))


@needs_tables
def test_foreign_and_noise_texts_are_rejected_and_clean_ones_stay(spark, frame):
    draw = np.random.default_rng(5)
    foreign = ["Вчера вечером мы долго гуляли по старому городу и говорили о том, как изменилась наша жизнь за последние годы.",
               "昨天晚上我们在老城区散步了很久，谈论着这些年来我们的生活发生了怎样的变化。后来下雨了，我们就回家了。",
               "Eilen illalla kävelimme pitkään vanhassa kaupungissa ja puhuimme siitä, miten elämämme on muuttunut viime vuosina.",
               "Dün akşam eski şehirde uzun süre yürüdük ve son yıllarda hayatımızın nasıl değiştiğini konuştuk.",
               "Wczoraj wieczorem długo spacerowaliśmy po starym mieście i rozmawialiśmy o tym, jak zmieniło się nasze życie."]
    for words in (60, 6000):
        foreign.append(" ".join("".join(map(chr, draw.integers(97, 123, draw.integers(3, 10)))) for _ in range(words)))
        foreign.append(base64.b64encode(draw.bytes(words * 6)).decode())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = lang_id.fit_language_centroids(docs.where(queries._fold(4) != 2), "doc_id", "text", "lang")
    got = lang_id.predict_language(frame([(i, t) for i, t in enumerate(foreign)], "dataset bigint, provenance string"), model)
    assert [r.dataset for r in got.collect() if not r.rejected] == []
    assert lang_id.predict_language(docs, model, "doc_id", "text").where("rejected").count() == 0


def test_document_frequencies_count_all_labelled_texts(frame):
    rows = [(i, "alpha beta" if i % 2 else "gamma", "en") for i in range(40)]
    model = lang_id.fit_language_centroids(frame(rows, "dataset bigint, provenance string, lang string"), per_language=4)
    fold = lang_id._folding()
    half, never = (lang_id.trigram_counts(t, fold) > 0 for t in ("alpha", "zzz"))
    assert model.idf[half] == pytest.approx(np.log(41 / 21) + 0.1) and model.idf[never].min() == pytest.approx(model.idf.max())


@needs_tables
def test_quality_of_held_out_documents(spark):
    got = queries.QUERIES["op7_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").toPandas()
    held = got[got.held_out]
    assert len(held) > 10 and (held.predicted == held.quality).mean() > 0.9


def test_quality_pair_sums_and_edges(frame):
    draw = np.random.default_rng(1)
    n = (1 << quality_fm.BITS) + len(quality_fm.STATISTICS)
    model = quality_fm.FactorisationMachine(0.3, draw.normal(size=n), draw.normal(size=(n, 3)))
    at, x = np.array([3, 70, 900]), np.array([0.5, -1.0, 2.0])
    raw, _ = quality_fm._pair_sums(model, at, x, np.array([0]))
    naive = 0.3 + model.weights[at] @ x + sum(model.factors[at[i]] @ model.factors[at[j]] * x[i] * x[j] for i in range(3) for j in range(i + 1, 3))
    assert raw[0] == pytest.approx(naive)
    good, bad = "alpha beta gamma delta", "ALPHA!! BETA!! GAMMA!!"
    rows = [(i, good if i % 2 else bad, i % 2) for i in range(40)] + [(None, good, 1), (98, None, 1), (99, "", 0), (1, good, 1), (97, good, None)]
    labelled = frame(rows, "dataset bigint, provenance string, quality int")
    fitted = quality_fm.fit_quality(labelled, labelled)
    got = quality_fm.score_quality(frame([(i, t, "x") for i, t, _ in rows] + [(7, "long " * 50000, "x")], "dataset bigint, provenance string, score string"), fitted).collect()
    assert len(got) == len(rows) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    assert all(r.predicted == q for r, (_, t, q) in zip(got, rows) if t and q is not None)
    assert quality_fm.score_quality(labelled.limit(0), fitted).collect() == []
    with pytest.raises(ValueError):
        quality_fm.fit_quality(labelled, labelled.limit(0))


QUESTION = "Anna has 3 apples and buys 5 more apples at the market for 12 dollars before she walks home"


def test_leaks_by_template(frame):
    other = "Intro text. " + QUESTION.replace("3", "7").replace("5", "9").replace("12 dollars", "44 euros") + ". And more."
    mixed = ("Tom saw that 4 red birds met 4 blue birds on 4 old trees near 4 wide rivers in the valley of the green hills today", )
    items = frame([(1, QUESTION), (2, None), (3, "too short"), (4, mixed[0]), (5, QUESTION)], "item_id bigint, text string")
    rows = [(10, QUESTION.upper().lower()), (11, other), (12, QUESTION.split(" before")[0]), (13, None), (14, ""), (15, "nothing of the kind here " * 9000),
            (None, QUESTION), (10, QUESTION), (16, mixed[0].replace("4 blue", "5 blue").replace("4 wide", "6 wide"))]
    data = frame([(*r, 5) for r in rows], "dataset bigint, provenance string, item_windows int")
    got = {(r.dataset, r.item_id): r.reparameterised for r in find_leaks(data, items).collect()}
    assert got == {(10, 1): False, (10, 5): False, (11, 1): True, (11, 5): True, (12, 1): False, (12, 5): False}
    left = drop_leaks(data, items)
    assert left.columns == data.columns and sorted(str(r.dataset) for r in left.collect()) == ["13", "14", "15", "16", "None"]
    assert find_leaks(data.limit(0), items).collect() == [] and find_leaks(data, items.limit(0)).collect() == []
    with pytest.raises(ValueError):
        find_leaks(data, items, width=6)


def found_in(frame, items, texts):
    got = find_leaks(frame(list(enumerate(texts)), "dataset bigint, provenance string"),
                     frame(list(enumerate(items)), "item_id bigint, text string"))
    return {(r.item_id, r.dataset): r.reparameterised for r in got.collect()}


def test_names_at_sentence_starts_are_slots(frame):
    item = "Tom has 3 red balls. Mary has 5 blue balls. Tom gives Mary 2 balls. How many balls does Tom have now?"
    other = item.replace("Tom", "Peter").replace("Mary", "Anna").replace("3", "7")
    apart = "Peter has seen the red hills. Anna has been there too. How many hills does Peter know now?"
    assert found_in(frame, [item], [item, other, "Read this.\n" + other, apart]) == {(0, 0): False, (0, 1): True, (0, 2): True}


def test_short_items_and_items_rich_in_slots(frame):
    short, rich = "What is the capital of France?", "Anna 3, Tom 4, Mary 5: give 12 to Anna 3, Tom 4, Mary 5"
    middle = "the small grey cat walked over the wet garden wall before the rain had stopped"  # 15 words
    texts = ["He asked: " + short, short.replace("France", "Spain"), "What is the colour of France?", "So. " + rich + ".",
             rich.replace("Anna", "Eve").replace("4", "9"), "Anna 1, Tom 2, Mary 3: give 4 to Anna 5, Tom 6, Mary 7",
             "And then " + middle.replace("wet", "old") + " again", middle.replace("wet ", ""), "the small grey cat sat and slept before the rain had come"]
    assert found_in(frame, [short, rich, middle], texts) == {(0, 0): False, (0, 1): True, (1, 3): False, (1, 4): True, (2, 6): False, (2, 7): False}


def test_urls(frame):
    assert split_url("HTTP://Ex.COM:80?q") == ("ex.com:80", "") and split_url("x.com/a") == ("", "") and split_url(None) == ("", "")
    rules = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("COM", "/", "allow"), (None, None, "block")]
    urls = ["http://www.example.com/en/1", "http://a.example.com/en/1#x", "http://badexample.com/en/", "http://x.net/es/?a", "http://x.net/en/", "http://x.com", None, "no url",
            "https://net/es/", "http://example.com/EN/", "http://" + "a." * 300 + "com/" + "x" * 5000]
    data = frame([(i, u, "v") for i, u in enumerate(urls)] + [(None, urls[0], "v"), (0, urls[0], "v")], "dataset bigint, url string, verdict string")
    got = filter_urls(data, frame(rules, "host string, path string, verdict string")).collect()
    want = [("www.example.com/en/", "allow"), ("example.com/en/", "block"), ("com/", "allow"), ("net/es/", "block"), (None, "allow"), (None, "allow"), ("", "block"),
            ("", "block"), ("net/es/", "block"), ("com/", "allow"), ("com/", "allow"), ("www.example.com/en/", "allow"), ("www.example.com/en/", "allow")]
    assert [(r.rule, r.verdict) for r in got] == want
    none = filter_urls(data, frame([], "host string, path string, verdict string"), otherwise="block").collect()
    assert {(r.rule, r.verdict) for r in none} == {(None, "block")}
    assert filter_urls(data.limit(0), frame(rules, "host string, path string, verdict string")).collect() == []
    with pytest.raises(ValueError):
        filter_urls(data, frame([("a", "/", "maybe")], "host string, path string, verdict string"))


def test_archives_round_trip(frame, tmp_path):
    long = "é<p>" * 4000
    rows = [(1, "http://a/", long), (2, None, long), (3, "http://b/\r\nX: y", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", "y" * 999), (8, "u", "y" * 999),
            (9, "u", "z" * 3_000_000)]
    listing = write_archives(frame([(*r, 0) for r in rows], "record_id bigint, url string, content string, id int"), archive_bytes=2000)
    got = {r.id: r for r in read_archives(listing).collect()}
    assert len(got) == len(rows)
    for i, url, content in rows:
        body, r = (content or "").encode(), got[i]
        assert (r.payload_bytes, r.payload_digest) == (len(body), hashlib.sha1(body).hexdigest())
        assert (r.record_type, r.refers_to) == (("revisit", 2) if i == 1 else ("response", None))
        assert bytes(r.payload) == body if i != 1 else r.payload is None
    path = listing.first().archive.removeprefix("file:")
    with open(path, "rb") as file:
        members = list(read_members(file))
    assert b"".join(members) == gzip.open(path).read() and all(parse_record(m)[0]["content-length"] for m in members)
    with pytest.raises(ValueError):
        parse_record(members[0] + b"x")
    assert read_archives(write_archives(frame([], "record_id bigint, url string, content string"))).collect() == []
    with pytest.raises(Exception, match="needs an id"):
        write_archives(frame([(None, "u", "x")], "record_id bigint, url string, content string"))


def test_archive_cut_short_is_an_error(frame):
    listing = write_archives(frame([(i, "u", "text " * 500) for i in range(3)], "record_id bigint, url string, content string"))
    path = listing.first().archive.removeprefix("file:")
    data = Path(path).read_bytes()
    Path(path).write_bytes(data[:len(data) // 2])
    with pytest.raises(Exception, match="archive|records"):
        read_archives(listing).collect()




def test_every_archive_has_a_reading_task(frame):
    listing = write_archives(frame([(i, "u", f"text {i} " * 500) for i in range(12)], "record_id bigint, url string, content string")
                             .repartition(6), archive_bytes=1000)
    n = listing.count()
    read = read_archives(listing)
    assert n >= 6 and read.rdd.getNumPartitions() == n
    assert sorted(r.id for r in read.collect()) == list(range(12))
