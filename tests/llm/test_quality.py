import math
from collections import Counter

import pytest

from cellarflow.llm.prose import ProseModel, kind_of, repeated_share, sentences_of
from cellarflow.llm import quality
from cellarflow.llm.quality import ALL, STATISTICS, bucket, fit_judge, language, measure_texts, not_prose, scales, sketches, text_quality, text_statistics, word_lists
from pyspark.sql import functions as F

DOCS = "doc_id bigint, text string, lang string, kind string, scale int, n_words int"
SAMPLES = "text string, lang string, kind string"
WORDS = "lang string, word string, place int"
PROSE = ["The malt is warm and the room smells of hay when the doors are open.", "We bought six bottles for a dinner and nobody asked for anything else.", "It is a dark beer that you can drink with a plain soup in the winter."]
LIST = "- pale ale\n- dark malt\n- dry hops\n- warm malt\n- sea salt"
TABLE = "ale,12,3.50,north\nmalt,7,1.20,south\nhops,9,8.00,north"
JUNK = "qweqwe asdasd zxczxc qwe asd qweqweqwe asdasd zxc qwe asd zxcv asdf qwer"
COMMON = ["the", "and", "of", "a", "is", "for", "with", "that", "you", "we", "it", "in", "when", "are", "can"]


@pytest.fixture
def frames(spark):
    samples = [(p, "en", "prose") for p in PROSE] + [(LIST, "en", "list"), (TABLE, "en", "table"), (JUNK, "en", "junk"), (None, None, None), ("x", None, None)]
    return spark.createDataFrame(samples, SAMPLES), spark.createDataFrame([("en", w, i) for i, w in enumerate(COMMON)] + [(None, None, None)], WORDS)


def judge():
    return ProseModel.fit([(p, "en", "prose") for p in PROSE] + [(LIST, "en", "list"), (TABLE, "en", "table")], [("en", w) for w in COMMON])


@pytest.mark.parametrize("layout", ["{}", "{0}\n{0}", "  {}\n\n", "— {}", '"{}"', "<p>{}</p>"])
@pytest.mark.parametrize("style", [str, str.upper, lambda s: s.replace(".", "!!!")])
def test_sentences_stay_prose_in_any_layout(layout, style):
    assert kind_of(judge().shares(layout.format(style(" ".join(PROSE))))) == "prose"


def test_wrapped_and_unpunctuated_sentences():
    text = " ".join(PROSE)
    wrapped, line = [], ""
    for w in text.split():
        if len(line) + len(w) > 60:
            wrapped.append(line)
            line = ""
        line = f"{line} {w}".strip()
    assert kind_of(judge().shares("\n".join([*wrapped, line]))) == "prose"
    assert kind_of(judge().shares(text.lower().replace(".", ""))) == "prose"


@pytest.mark.parametrize("text,kind", [
    (LIST, "list"), (TABLE, "table"), (JUNK, None), (" ".join(["pale ale"] * 40), "junk"), ((PROSE[0] + " ") * 9, "junk"), ("~*" * 50, "junk"),
    (" ".join(COMMON * 3), "junk"), ("ale / malt / dry hops / pale ale / sea salt", None), ("\n".join(sorted(" ".join(PROSE).split())), None),
    ("1,a bottle of the malt for the shelf,4,no\n2,two of the pale ale and one with hops,5,yes", "table"),
])
def test_what_is_not_prose(text, kind):
    got = kind_of(judge().shares(text))
    assert got != "prose" and (kind is None or got == kind)


def test_share_is_by_characters():
    assert kind_of(judge().shares(PROSE[0] + "\n" + LIST)) == "prose"
    assert kind_of(judge().shares(PROSE[0] + "\n" + "\n".join(f"- pale ale {i}" for i in range(20)))) == "list"


def test_blank_and_parts():
    assert judge().shares(" \n\t ") == {} and kind_of({}) is None
    assert repeated_share("a b a b a b a b a b".split()) > 0.5 and not repeated_share("a b c d e f g h".split())
    assert sentences_of("One. Two! Three") == ["One.", "Two!", "Three"]


def test_repetition_of_any_length_and_start():
    long = " ".join(PROSE) + " " + " ".join(f"We bought bottle {i} of the dark beer for you." for i in range(5))
    assert len(long.split()) > 60 and kind_of(judge().shares(long)) == "prose"
    assert kind_of(judge().shares("\n".join([long] * 4))) == "junk" and kind_of(judge().shares("\n".join([long] * 2))) == "prose"
    assert kind_of(judge().shares(" ".join([PROSE[1], *[PROSE[0]] * 4]))) == "junk"
    assert kind_of(judge().shares(" ".join([*PROSE[1:], *PROSE[1:], *[PROSE[0]] * 3]))) == "prose"
    ja = "".join(chr(0x3042 + i % 70) for i in range(64))
    assert kind_of(judge().shares(ja * 5)) == "junk"
    assert repeated_share("x a a a a b a a a a b a a a a b a a a a b".split()) > 0.5
    assert repeated_share("a b c a b c a b c d e f g h".split()) == 0.0


def test_quality_of_edge_cases(spark, frames):
    rows = [(1, PROSE[0], "en", "x", 1, 1), (2, None, None, "x", 1, 1), (3, "", "EN-gb", "x", 1, 1), (4, " \n ", " de ", "x", 1, 1), (5, LIST, "??", "x", 1, 1), (None, PROSE[0], "en", "x", 1, 1), (6, "word " * 200_000, "en", "x", 1, 1), (1, PROSE[0], "en", "x", 1, 1)]
    got = sorted(text_quality(spark.createDataFrame(rows, DOCS), *frames).collect(), key=lambda r: (r.doc_id, r.lang))
    assert [r.doc_id for r in got] == [1, 1, 2, 3, 4, 5, 6]
    by = {r.doc_id: r for r in got}
    assert by[1].kind == "prose" and by[1].n_words == 15 and by[1].ended_line_share == 1 and by[1].distinct_share == pytest.approx(len(set(PROSE[0].lower().strip(".").split())) / 15)
    assert by[2].n_words is None and by[2].kind is None and not by[2].suspect
    assert by[3].n_words == 0 and by[3].kind is None and (by[3].lang, by[4].lang, by[5].lang) == ("en", "de", "und")
    assert by[6].n_words == 200_000 and by[6].kind == "junk"


def test_empty(spark, frames):
    assert text_quality(spark.createDataFrame([], DOCS), *frames).collect() == []


def many(n):
    return [(i, " ".join(PROSE[j] for j in (i % 3, (i + 1) % 3)) + f" We bought {i} of it.", "en", "", 0, 0) for i in range(n)]


def test_tails_lead_to_the_check(spark, frames):
    q = text_quality(spark.createDataFrame(many(60) + [(100, LIST, "en", "", 0, 0), (101, TABLE, "en", "", 0, 0)], DOCS), *frames)
    assert {r.doc_id for r in not_prose(q).collect()} == {100, 101}
    by = {r.doc_id: r for r in q.collect()}
    assert "common_share" in by[100].tails and by[100].z_common_share < -3.5 and by[100].p_common_share < 0.05
    assert by[100].suspect and by[100].natural_share < 0.5 and by[1].kind == "prose"


def test_only_suspects_reach_the_judge(spark, frames, monkeypatch):
    """A judge that condemns all it gets: what lies in no tail of labelled prose is prose without it."""
    rows = spark.createDataFrame(many(30) + [(100 + i, (LIST, TABLE)[i % 2], "en", "", 0, 0) for i in range(6)], DOCS)
    frames = spark.createDataFrame([(r[1], "en", "prose") for r in many(60)], SAMPLES), frames[1]
    real = quality._measure

    class Harsh(ProseModel):
        def shares(self, text):
            return {"junk": 1.0}

    monkeypatch.setattr(quality, "_measure", lambda common, tails, judge: real(common, tails, Harsh()))
    assert sorted(r.doc_id for r in not_prose(measure_texts(rows, *frames)).collect()) == list(range(100, 106))


@pytest.mark.parametrize("n_prose", [0, 100])
def test_a_corpus_of_mostly_other_kinds_comes_out(spark, n_prose):
    """The documents that the judge alone takes for no prose, by themselves and with as many as 100 of prose."""
    docs, *frames = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "prose_samples", "common_words"))
    judge = fit_judge(docs, *frames)
    texts = [(r.doc_id, r.text, r.lang, kind_of(judge.shares(r.text))) for r in docs.where("text is not null").collect()]
    other = [t for t in texts if t[3] not in (None, "prose")]
    rows = spark.createDataFrame([t[:3] for t in other + [t for t in texts if t[3] == "prose"][:n_prose]], "doc_id bigint, text string, lang string")
    found = {r.doc_id for r in not_prose(measure_texts(rows, *frames)).collect()}
    assert len(other) > 100 and len(found & {t[0] for t in other}) >= 0.99 * len(other) and len(found) <= len(other)


def test_a_long_passage_over_and_over_is_found(spark, frames):
    passage = " ".join(PROSE) + " " + " ".join(f"On day {x} we bought another bottle and drank it with {y}." for x, y in zip("one two three".split(), "bread cheese soup".split()))
    assert 61 < len(passage.split()) < 100
    got = measure_texts(spark.createDataFrame([(1, "\n".join([passage] * 20), "en", "", 0, 0), (2, passage, "en", "", 0, 0)], DOCS), *frames)
    assert {r.doc_id: r.kind for r in got.collect()} == {1: "junk", 2: "prose"}


def test_word_lists_have_no_bound(spark, frames):
    words = spark.createDataFrame([("en", f"w{i}", i) for i in range(100_500)], WORDS)
    assert len(word_lists(spark.createDataFrame([], DOCS), words)) == 100_500


def test_statistics_by_hand():
    got = dict(zip([*STATISTICS, "unspaced"], text_statistics("The ale, the malt.\n\n12 of it | no end", frozenset(["the", "of", "it"])), strict=True))
    solid = len("Theale,themalt.12ofit|noend")
    assert (got["n_words"], got["unspaced"]) == (8, False)
    want = {"mean_word_length": 22 / 8, "symbol_share": 3 / solid, "digit_share": 2 / solid, "ended_line_share": 0.5, "common_share": 4 / 8, "distinct_share": 7 / 8,
            "pair_share": 1.0, "sentence_share": 1.0, "separator_share": 2 / 22, "stop_gap": 22.0}
    assert {k: got[k] for k in want} == pytest.approx(want)
    ja = text_statistics("これは麦です。", frozenset())
    assert ja[-1] is True and ja[STATISTICS.index("common_share")] == pytest.approx(5 / 6)
    assert text_statistics("", frozenset())[:2] == (0, 0.0) and text_statistics(None, frozenset()) == (None,) * 12


@pytest.mark.parametrize("n_prose,n_other", [(60, 30), (30, 60)])
def test_every_case_is_suspect_at_any_mix(spark, frames, n_prose, n_other):
    rows = [(i, " ".join(PROSE[j] for j in (i % 3, (i + 1) % 3)) + f" We bought {i} of it.", "en", "", 0, 0) for i in range(n_prose)]
    rows += [(1000 + i, (LIST, TABLE)[i % 2], "en", "", 0, 0) for i in range(n_other)] + [(2000 + i, " ", ("en", "ja")[i % 2], "", 0, 0) for i in range(4)]
    q = text_quality(spark.createDataFrame(rows, DOCS), *frames)
    assert sorted(r.doc_id for r in not_prose(q).collect()) == [1000 + i for i in range(n_other)]


def test_sketches_merge_and_bound_quantiles(spark):
    rows = [(i, "en" if i % 3 else "it", i % 97, 1 + (i % 7) / 3, (i % 50) / 50, *[0.5] * 8) for i in range(500)]
    stats = spark.createDataFrame(rows, "doc_id bigint, lang string, n_words bigint, " + ", ".join(f"{s} double" for s in STATISTICS[1:]))
    whole = Counter({(r.lang, r.stat, r.bucket): r.n for r in sketches(stats).collect()})
    halves = sum((Counter({(r.lang, r.stat, r.bucket): r.n for r in sketches(stats.where(f"doc_id % 2 = {h}")).collect()}) for h in (0, 1)), Counter())
    assert whole == halves
    scale = {r.lang: r.scale for r in scales(sketches(stats)).collect()}
    exact = sorted(r[2] for r in rows)[249]
    assert scale[ALL]["n_words"]["median"] == pytest.approx(exact, rel=0.06)
    en = sorted(r[4] for r in rows if r[1] == "en")
    assert scale["en"]["symbol_share"]["median"] == pytest.approx(en[len(en) // 2], abs=0.021)
    ranks = {r.doc_id: r.b for r in stats.select("doc_id", bucket("n_words").alias("b")).collect()}
    for i in (3, 90, 250):
        p = scale[ALL]["n_words"]["p"][ranks[i]]
        below = sum(r[2] < rows[i][2] for r in rows) / 500
        assert abs(p - below) < 0.08 and math.isfinite(p)


def test_languages(spark):
    values = [("EN-gb", "en"), (" it ", "it"), (None, "und"), ("", "und"), ("1x", "und"), ("ja_JP", "ja")]
    got = spark.createDataFrame([(a, b) for a, b in values], "a string, b string").select(language("a").alias("x"), "b").collect()
    assert all(r.x == r.b for r in got)


def test_learnt_words_and_held_out_accuracy(spark, small):
    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet")
    model = fit_judge(read("documents"), read("prose_samples"), read("common_words"))
    assert {"não", "uma", "com"} <= set(model.by_lang["pt"])
    rows = [(r.text, r.lang, r.kind) for r in read("prose_samples").orderBy(F.xxhash64("text")).collect()]
    words = [(r.lang, r.word) for r in read("common_words").collect()]
    wrong = 0
    for fold in range(4):
        m = ProseModel.fit([r for i, r in enumerate(rows) if i % 4 != fold], words)
        wrong += sum((kind_of(m.shares(r[0])) == "prose") != (r[2] == "prose") for i, r in enumerate(rows) if i % 4 == fold)
    assert wrong <= 0.03 * len(rows)
    assert len(STATISTICS) == 11
