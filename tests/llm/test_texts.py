"""Operators on single texts: tokens, sentences, personal information."""

import base64
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from factloom.llm import bpe, pii, sentences

DOCS = "doc_id bigint, text string, ids string, extra int"


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(open(bpe.VOCABULARY, "rb").read())


@pytest.fixture(scope="module")
def library(encoder):
    import tiktoken

    return tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=encoder.ranks, special_tokens={})


@given(st.text(max_size=200))
@settings(max_examples=300, deadline=None)
def test_bpe_equals_the_library(encoder, library, text):
    text = text.encode("utf-8", "ignore").decode()
    assert encoder.encode(text) == library.encode_ordinary(text)


def test_bpe_long_pre_tokens(encoder, library):
    r = random.Random(1)
    for letters in ("ab", "abcdefghij", "aé的ไ"):
        text = "".join(r.choice(letters) for _ in range(20_000))
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text) and library.decode(ids) == text


def test_bpe_table(spark, library):
    texts = [None, "", "<|endoftext|> hi", " a\r\n\tb ", "x" * 50_000, "hi", "hi"]
    got = {r.doc_id: list(r.ids) for r in bpe.token_ids(spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], DOCS)).collect()}
    assert got == {i: library.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert bpe.token_ids(spark.createDataFrame([], DOCS)).count() == 0
    assert bpe.VOCABULARY and base64


PII = [
    ("Call Lindides, André on +1 390 555 0181 or write to hakon60[at]corvid-mail[dot]example.", ["Lindides, André", "+1 390 555 0181", "hakon60[at]corvid-mail[dot]example"]),
    ("Signed, P. Grimmunth", ["P. Grimmunth"]), ("Dr. Jean-Luc Wickingmoor moved the practice to 80 bis, rue des Tilleuls-Gris.", ["Jean-Luc Wickingmoor", "80 bis, rue des Tilleuls-Gris"]),
    ("I live at Flat 5, 231 Quillon Street now, the blue door.", ["Flat 5, 231 Quillon Street"]), ("Meine Nummer ist 0049-30-23125237, Adresse Am Tolvenring 2 b.", ["0049-30-23125237", "Am Tolvenring 2 b"]),
    ("y vivo en Plaza Larga 17, 7º C.", ["Plaza Larga 17, 7º C"]), ("my national ID, which is 99958534-M.", ["99958534-M"]), ("Passport no. P<6655209 expires in March 2021.", ["P<6655209"]), ("SSN on file QQ 37 92 04 C, please hide it.", ["QQ 37 92 04 C"]),
    ("write to udunnowicz at inbox dot invalid.", ["udunnowicz at inbox dot invalid"]), ("remember that jean-luc kaldombe is my landlord", ["jean-luc kaldombe"]),
    ("Order 281-31293-237 and ticket #13232190, see @jazz45. Please mail it to [EMAIL] as before. Fact 27efa85172f419c6. The sum was 147.125 + 316.296. Platform 28 at Quarry Hill station. I work at Nimbule Design Studio.", []),
    ("", []), (None, []),
]


@pytest.fixture(scope="module")
def learned(spark, data):
    return pii.NameModel(pii.learned(pii.name_words(spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/entities.parquet"))))


@pytest.mark.parametrize("text,want", PII)
def test_pii(learned, text, want):
    assert [text[a:b] for a, b, _ in pii.spans(text, learned)] == want


def test_pii_validators():
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112") and pii.mod97("GB82 WEST 1234 5698 7654 32") and not pii.mod97("GB83WEST12345698765432") and pii.dni("12345678Z") and not pii.dni("12345678A")
    assert pii.nir("1 85 05 78 006 084 91") and not pii.nir("1 85 05 78 006 084 92") and pii.pesel("44051401359") and not pii.pesel("44051401358") and pii.luhn10("850709-9805") and not pii.luhn10("850709-9806") and pii.codice("RSSMRA85T10A562S") and not pii.codice("RSSMRA85T10A562T")
    for yes, no in (("my id is 850709-9805", "my id is 850709-9806"), ("PESEL 44051401359, on file", "PESEL 44051401358, on file"), ("RSSMRA85T10A562S it is", "RSSMRA85T10A562T it is"), ("social insurance 046 454 286", "social insurance 046 454 287")):
        assert "[ID_NUMBER]" in pii.redact(yes) and "[ID_NUMBER]" not in pii.redact(no), yes
    assert "[ID_NUMBER]" not in pii.redact("my card 4111 1111 1111 1111 and account GB82 WEST 1234 5698 7654 32")


@given(st.text(alphabet="aA .,@019-()Müé\n<[]", max_size=120))
@settings(max_examples=200, deadline=None)
def test_pii_spans_never_overlap(text):
    at = 0
    for a, b, _ in pii.spans(text):
        assert at <= a < b <= len(text)
        at = b


def test_pii_table(spark):
    t = spark.createDataFrame([("turn", 1, "hi " * 50_000 + "Signed, Hiroshi Tanaka"), ("turn", 2, None), ("fact", 3, "")], "origin string, record_id bigint, text string")
    assert [(r.record_id, r.start_at, r.kind) for r in pii.found(t).collect()] == [(1, 150_008, "person_name")]
    assert [r.text[-13:] if r.text else r.text for r in pii.redacted(t).orderBy("record_id").collect()] == ["[PERSON_NAME]", None, ""]


FOREIGN = [
    ("Wei Zhang called me", ["Wei Zhang"]), ("Mr. Wei Zhang is here", ["Wei Zhang"]), ("I met Oluwaseun Adeyemi in Lagos.", ["Oluwaseun Adeyemi"]), ("Dear Nguyen Thi Hoa, thanks.", ["Nguyen Thi Hoa"]), ("My doctor is Fatima Al-Sayed.", ["Fatima Al-Sayed"]),
    ("Hiroshi Tanaka called yesterday.", ["Hiroshi Tanaka"]), ("Please contact Linda Carter tomorrow.", ["Linda Carter"]), ("The report was written by Olga Petrovna.", ["Olga Petrovna"]), ("Kevin Nguyen will join us.", ["Kevin Nguyen"]),
    ("Ring me on 020 7946 0958 tonight", ["020 7946 0958"]), ("She lives at Via Roma 12, Milano", ["Via Roma 12"]), ("Platform 28 at Quarry Hill station. I work at Nimbule Design Studio.", []), ("We saw Silver Lining with Golden Gate from far.", []),
]


@pytest.mark.parametrize("text,want", FOREIGN)
def test_names_of_any_vocabulary(text, want):
    assert [text[a:b] for a, b, _ in pii.spans(text)] == want


def test_the_name_model_is_learned(spark):
    e = spark.createDataFrame([("Zhangwen, Weilong", "person"), ("Weilong Q. Brontide", "person"), ("Blue Heron", "org"), (None, "person"), ("", "person"), ("user", "person")] + [(f"{c}ora {c}tarkel", "person") for c in "bcdfghjklm"], "name string, entity_type string")
    m = pii.NameModel(pii.learned(pii.name_words(e)))
    assert m["weilong"] & pii.IS_GIVEN and m["brontide"] & pii.IS_FAMILY and m["heron"] & pii.IS_OTHER and not m["user"] and m["ventarkel"] & pii.IS_FAMILY and not m["lunch"]
    t = spark.createDataFrame([("turn", 1, "lunch for weilong zhangwen at noon"), ("turn", 2, "I called Blue Heron today"), ("fact", 1, "nothing"), ("fact", 2, None)], "origin string, record_id bigint, text string")
    assert [tuple(r) for r in pii.found(t, e).collect()] == [("turn", 1, 10, 26, "person_name")]
    assert {r.text for r in pii.redacted(t, e).collect()} == {"lunch for [PERSON_NAME] at noon", "I called Blue Heron today", "nothing", None}
    assert [r.record_id for r in pii.found(t, e.limit(0)).collect()] == [2]  # without the table Blue Heron is not known to be no person


def test_many_spans_of_one_text_take_linear_time():
    import time

    took = []
    for n in (3000, 30_000):
        began = time.perf_counter()
        assert len(pii.spans("Call Linda Carter on +1 390 555 0181 now. " * n)) == 2 * n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]


@pytest.fixture(scope="module")
def model(spark, data):
    docs = spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet")
    return sentences.fitted(sentences.written(sentences.found_places(docs), "places"))


SENTENCES = [
    "Dr. Ferrwyn changed my dose to 15.22 mg on 7 January.|What a day!|“Take it,” he said, “you'll need it.”|We met there.",
    'She said, "I sold the desk. It was too dull." and hung up.|(I had sold it, by the way.)|3 of the pages were blank.',
    "Known facts about the user\n\n|Fact one was closed.|\n- likes: tea\n|- budget: 3\n\n|[0] user: Hello there.|\n[1] assistant: Hi!",
    "Nobody there expected the nurse to carry\na pack across the town merely to win\n201 points at chess.|It rained.",
    "他说「好」，然后关上了门！|“你要来吗？”他在车站问我。|我有三只猫，不是两只。",
    "„Warte! Ich komme gleich.“ rief sie und lief zum Bus.|Am 14.8. um 1:10 Uhr fahre ich nach Bonn.",
    "Great work! 🎉|See you…",
]


@pytest.mark.parametrize("marked", SENTENCES)
def test_sentences(model, marked):
    text = "".join(p if i == 0 or p.startswith("\n") or marked.split("|")[i - 1].endswith(("\n", "！", "。")) else " " + p for i, p in enumerate(marked.split("|")))
    assert [text[a:b] for a, b in sentences.split(text, model)] == [p.strip() for p in marked.split("|")]


@given(st.text(alphabet="aB .!?\n\"'“”()。ไ 1-,…", max_size=80))
@settings(max_examples=300, deadline=None)
def test_sentences_cover_all_but_white_space(model, text):
    at = 0
    for a, b in sentences.split(text, model):
        assert text[at:a].strip() == "" and a < b and text[a:b] == text[a:b].strip()
        at = b
    assert text[at:].strip() == ""


def test_sentence_table(spark, model):
    docs = spark.createDataFrame([(1, None, "", 0), (2, " \n", "", 0), (3, "One. Two.", "", 0), (4, "word " * 20_000 + "end. Next one.", "", 0)], DOCS)
    got = [(r.doc_id, r.start_at, r.end_at) for r in sentences.sentences(docs, model).collect()]
    assert (3, 0, 4) in got and (3, 5, 9) in got and {g[0] for g in got} == {3, 4}
    assert sentences.split("Yes. No.", sentences.Model.fit([])) and sentences.sentences(spark.createDataFrame([], DOCS)).count() == 0
    own = [(r.doc_id, r.start_at, r.end_at) for r in sentences.sentences(docs).collect()]  # fitted on these four
    assert {g[0] for g in own} == {3, 4} and (3, 0, 4) in own


def test_the_model_of_a_corpus_is_that_of_its_texts(spark, data):
    import numpy as np

    docs = spark.read.parquet(f"{data}/documents.parquet")
    texts = [r.text for r in docs.where("length(text) > 0").collect()]
    one = sentences.Model.fit(texts)
    whole = sentences.fitted(sentences.written(sentences.found_places(docs.repartition(3)), "places"))
    assert np.allclose(one.c.flat, whole.c.flat) and np.allclose(one.e.flat, whole.e.flat)


def test_a_larger_corpus_moves_few_boundaries(spark, data):
    texts = [r.text for r in spark.read.parquet(data.replace("sf0.001", "sf0.01") + "/documents.parquet").where("length(text) > 0").collect()]
    one, four = sentences.Model.fit(texts), sentences.Model.fit(texts * 4)
    a, b = ([set(sentences.split(t, m)) for t in texts] for m in (one, four))
    assert sum(len(x & y) for x, y in zip(a, b, strict=True)) >= 0.995 * sum(map(len, a))


def test_posteriors_against_all_ways_to_cut(model):
    import itertools

    import numpy as np

    r = random.Random(3)
    texts = ["Dr. Ferr was here. No. 5 is e.g. Mr. Smith. I. He said no. It", "A. B. C. D. e. F", "One", "Go. Go! No. What? Hm. Mr. X", "ฉันชอบ แมว มาก ไป ที่ นี่"]
    for _ in range(20):
        some = [r.choice(texts) for _ in range(4)]
        xs = [sentences.numbered(sentences.places(t), sentences._Numbers()) for t in some]
        x = np.concatenate(xs)
        first = np.cumsum([0, *[len(y) for y in xs if len(y)]])[:-1].astype(int)
        got, at = model.posteriors(x, first), 0
        for y in xs:
            if not len(y):
                continue
            p = model.chance(y)
            t = np.where((y[:, 2] == sentences.YES) | (y[:, 9] >= 2), 1.0, np.where(y[:, 9] == 1, 0.15, 0.02))
            mass, hit = 0.0, np.zeros(len(y))
            for way in itertools.product((0, 1), repeat=len(y)):
                w = np.prod([(p[i] * (t[i] if i and way[i - 1] else 1)) if e else 1 - p[i] for i, e in enumerate(way)])
                mass += w
                hit += w * np.array(way)
            assert np.allclose(got[at : at + len(y)], hit / mass, atol=1e-6)
            at += len(y)


def test_sentences_of_long_texts_take_linear_time(model):
    import time

    took = []
    for n in (2000, 20_000):
        began = time.perf_counter()
        assert len(sentences.split('He said, "we met (by chance) there." It was\nnice.\n' * n, model)) >= n
        took.append(time.perf_counter() - began)
    assert took[1] < 30 * took[0]
