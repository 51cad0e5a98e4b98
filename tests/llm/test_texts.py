import random
import time
import unicodedata
from pathlib import Path

import pytest

from quarryline.llm import bpe, kernel, leak, lookalike, sentences

VOCABULARY = Path(bpe.VOCABULARY)


def found(spark, quotes, passages):
    a = spark.createDataFrame([*enumerate(quotes)], "citation_id int, source_quote string")
    b = spark.createDataFrame([*enumerate(passages)], "query_id int, answer_passage string")
    return {tuple(r) for r in lookalike.look_alikes(a, "citation_id", "source_quote", b, "query_id", "answer_passage").collect()}


ALIKE = [("Ｆｉｌｅ １２", "File 12"), ("ﬁle oﬃce", "file office"), ("café", "café"), ("a​b­c", "abc"), ("a  b\r\nc", "a b c"), ("«x» – “y”", '"x" - "y"'), ("раge", "page"), (" x ", "x"),
         ("Νew ОRB", "New ORB"), ("e‍́", "é"), ("ｶﾞ", "ガ"), ("…", "..."), ("ᎪᏞL ոօ", "ALL no"), ("ⲞRB", "ORB"), ("𝐅𝐢𝐥𝐞 𝟙𝟛", "File 13"), ("ꓢEꓳ", "SEO"), ("𝛂𝛃", "αβ")]
UNLIKE = [("File", "file"), ("resume", "résumé"), ("x2", "x²"), ("a b", "ab"), ("1", "l"), ("a.", "a"), ("", " "), ("​", "")]


def test_look_alikes(spark):
    quotes = [a for a, _ in ALIKE + UNLIKE] + [None, "same"]
    passages = [b for _, b in ALIKE + UNLIKE] + [None, "same"]
    assert found(spark, quotes, passages) == {(i, i) for i in range(len(ALIKE))}
    assert found(spark, [], passages) == set()


def test_form_is_stable_and_classes_are_disjoint():
    table = lookalike.rewriting({"o": 3, "о": 9})
    rewrite = lookalike.Rewriter(table)
    rnd = random.Random(0)
    members = lookalike.members()
    assert len(members) == len(set(members))
    for _ in range(2000):
        t = "".join(rnd.choices([m for m in members if m] + list("abc é̂"), k=12))
        assert rewrite(rewrite(t)) == rewrite(t)
        assert rewrite(unicodedata.normalize("NFD", t)) == rewrite(t)
    assert rewrite("о") == rewrite("o") == "о" and rewrite(None) is None


def test_most_frequent_member_stands_for_its_class():
    assert lookalike.rewriting({"a": 1, "а": 5})["a"] == "а" and lookalike.rewriting({})["ﬁ"] == "fi"


@pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary here")
class TestBpe:
    def reference(self):
        import public_tokenizers
        import tiktoken

        v = bpe.Vocabulary.load(str(VOCABULARY))
        return v, tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=v.ranks, special_tokens={})

    def test_whole_texts(self, spark):
        _, enc = self.reference()
        rnd = random.Random(2)
        alphabet = "aab's 'll 're'ves\n\t  \r\n'd'm123½éß中文ก้😀😀'' .-_ <|endoftext|>"
        rows = ["".join(rnd.choices(alphabet, k=rnd.randint(0, 80))) for _ in range(2000)] + [None, "", " ", "'s", "<|endoftext|>", "word " * 70000]
        df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(rows)], "doc_id bigint, text string, ids int")
        got = {r["doc_id"]: r["ids"] for r in bpe.token_ids(df, "doc_id", "text").collect()}
        assert got == {i: enc.encode_ordinary(t or "") for i, t in enumerate(rows)}
        assert bpe.token_ids(df.limit(0), "doc_id", "text").count() == 0

    def test_appends_and_edits_keep_the_encoding(self):
        v, enc = self.reference()
        rnd = random.Random(3)
        for _ in range(300):
            text = "".join(rnd.choices("abcdeinrst", k=rnd.randint(1, 30)))
            p = bpe.Prefixes(v)
            for k, c in enumerate(text.encode()):
                p.append(bytes([c]))
                assert p.tokens() == [t for t in enc._core_bpe.encode_single_piece(text.encode()[: k + 1])]
            at = rnd.randint(0, len(text))
            p.replace(at, min(len(text), at + 2), b"xyz")
            assert p.tokens() == enc._core_bpe.encode_single_piece(p.piece)

    def test_an_edit_costs_its_surroundings_only(self):
        v, enc = self.reference()
        rnd = random.Random(5)
        piece = "".join(rnd.choices("abcdefghij" * 3 + "etaoin" * 5, k=20_000)).encode()
        p = bpe.Prefixes(v, piece)
        for at, to, new in ((5, 6, b"z"), (9_000, 9_000, b"insert"), (12_000, 12_400, b""), (19_600, 19_606, b"end")):
            assert p.replace(at, to, new) <= len(new) + 6 * v.longest
            assert p.tokens() == enc._core_bpe.encode_single_piece(p.piece)

    def test_pieces_of_one_hash_are_told_apart(self, monkeypatch):
        v, enc = self.reference()
        monkeypatch.setattr(kernel, "span_hash", lambda h, start, end: (end - start).astype("uint64") // 2)
        texts = ["one two three one for all ' 'll", "", "four words of some length", "one two"]
        ids, bounds = bpe.Encoder(str(VOCABULARY))(texts)
        assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [enc.encode_ordinary(t) for t in texts]


def words(t):
    out, w = [], ""
    for c in t + " ":
        if unicodedata.category(c)[0] in "LMN":
            w += c.lower()
        elif w:
            out, w = [*out, w], ""
    return out


def run(x, n):
    return {tuple(x[i : i + n]) for i in range(len(x) - n + 1)}


@pytest.mark.parametrize("bits", [27, 6])
def test_leaks_against_brute_force(spark, bits):
    """With a filter of 64 bits, nearly all shingles of the documents pass it."""
    rnd = random.Random(4)
    vocabulary = [f"w{i}" for i in range(40)] + ["é", "हिन्दी", "Straße"]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, text(rnd.randint(5, 40)), "en") for i in range(12)] + [(20, "".join(rnd.choices("天地玄黄宇宙洪荒12a", k=70)), "zh"), (21, None, "en"), (22, "", "ja"), (23, text(11), "de")]
    docs = []
    for i in range(40):
        w = items[rnd.randint(0, 11)][1].split()
        cut = w[(s := rnd.randint(0, 5)) : s + rnd.choice([11, 12, 13, 30])]
        docs.append((i, text(20) + ",\n" + "; ".join(x.upper() if x != "Straße" else x for x in cut) + ". " + text(rnd.randint(0, 9))))
    docs += [(50, "x" + items[12][1][10:39] + "y"), (51, "前 " + "，".join(items[12][1][10:40])), (52, None), (53, ""), (54, items[3][1])]
    want = set()
    for i, t, lang in items:
        f, n = ((lambda x: [c.lower() for c in x if unicodedata.category(c)[0] in "LN"]), 30) if lang in ("zh", "ja") else (words, 12)
        want |= {(i, d) for d, u in docs if t and u and run(f(t), n) & run(f(u), n)}
    a = spark.createDataFrame([(*r, 1) for r in items + items[:2]], "item_id bigint, text string, lang string, doc int")
    b = spark.createDataFrame([(*r, 1) for r in docs + docs[:3]], "doc_id bigint, text string, item int")
    got = leak.leaks(a, b, "item_id", "text", "lang", "doc_id", "text", bits)
    assert {tuple(r) for r in got.collect()} == want and len(want) > 10
    assert leak.leaks(a.limit(0), b, "item_id", "text", "lang", "doc_id", "text").count() == 0
    assert leak.leaks(a, b.limit(0), "item_id", "text", "lang", "doc_id", "text").count() == 0


#: "|" parts the sentences.
SENTENCES = [
    "Mr. A. Rao of Rislox Ltd. paid Rs. 5.25 at 2.57 p.m. to M/s. X & Co. under no. 7.|Then he left.",
    "It ends at 2.57 p.m.|(a) For the series, see para. 3 (cf. fig. 2.1).|18.21. On the day, stop!",
    'They asked "may we net off twice?" and were told no.|"The cap stays," said Dr. Zed, "until May 4, 2026."|Next one.',
    'He wrote: "Only 5 units move."|Stop all entries ... and wait.|It was levied per week.|Research goes on.',
    "Queries go to desk.Hal@notices.example or to a_b.csv today.|Is it?|Yes!",
    "Ab dem 3. Mai 2029 gilt z. B. die Grenze i. H. v. 5 Euro.|Frau X erklärte: „Das wird nicht verlängert.“|Die A GmbH u. a. haben es gem. Abs. 4 gemeldet.",
    "M. Organe a écrit : « Le plafond ne change pas. »|Le barème, etc., reste avant 6.59 h.|À compter du 1er mai !",
    "La Dra. Istgax señaló: «El tope sigue vigente».|¿Pueden revisarlo a las 4.26 p. m. de cada día?|¡No!|La firma X S. L. y otros, pág. 6.",
    "С 12 марта 2026 г. брокеры вносят 5 руб. за лот, т. е. всё.|Согласно п. 6.23 письма № 3.|В отчёте указано: «Предел 5 не меняется».|Да!",
    "परिपत्र क्र. 43774 के अनुसार रु. 5 देंगे।|डॉ. Orlemth ने बताया।|सूचना में लिखा है, \"मान्य नहीं होगा।\"|क्या?",
    "أوضح د. Quolemsk أن ذلك لا يتجاوز 17.2 في المئة.|جاء في الإشعار: «لا يقبل بعد الساعة 11.09.»|هل يجوز؟",
    "「受け付けません。」|2029年から差し入れる。|X社は「上限は5％である。」と回答した。|「はい。」|ただし、Ver.5.4は別。",
    "“上限是否不变？”，会员曾这样追问。|通知写道：“不再受理。”|“会员（含No.7账户）应按约2.5倍核算……并留存。”|是！",
    "บริษัท X แจ้งว่าไม่เกิน 5 เปอร์เซ็นต์ตามที่กำหนด| บริษัท Y แจ้งว่า 6 หน่วย",
]


@pytest.mark.parametrize("marked", SENTENCES)
@pytest.mark.parametrize("gap", [" ", "  ", "\n"])
def test_sentences(marked, gap):
    parts = [p.strip() for p in marked.split("|")]
    if "บ" in marked and gap == "\n":
        pytest.skip("a line end parts no Thai sentences")
    text = gap.join(parts)
    assert [text[s:e] for s, e in sentences.sentences(text)] == parts


@pytest.mark.parametrize("marked", [
    "The limit is a cap.|It applies from May.", "I like modern art.|She paints well.", "Press the Tab.|Then wait.", "This is lit.|Everyone agreed.", "See the ref.|The text follows.",
    "See the ref.|A man came.", "By art. 7 and Annex. A it holds.|See Sec. IV of ref. AB/CD/7.", "Das gilt nach Art. 5 und lit. B der Anl. 3.|Mehr nicht.", "Según el cap. 4 y el art. 7 no se paga.|Fin.",
    "He said no.|Then he left.", "สมาชิกแจ้งตั้งแต่ปี พ.ศ. 2570 เป็นต้นไป|ผู้ค้าจะแจ้งภายใน 5 วัน",
])
def test_abbreviations_of_the_text_s_own_language(marked):
    parts = marked.split("|")
    text = " ".join(parts)
    assert [text[s:e] for s, e in sentences.sentences(text)] == parts


def test_named_language_decides_where_words_do_not():
    assert len(sentences.sentences("Hr. Zwei", "de")) == 1 and len(sentences.sentences("Hr. Zwei", "en")) == 2


def test_list_levels():
    levels = sentences.Levels()
    for mark in ("1. ", "(a) ", "(b) ", "(i) ", "(ii) ", "(c) ", "2. "):
        goes_on = levels.goes_on(mark)
        levels.enter(mark)
        assert goes_on == (mark not in ("1. ", "(a) ", "(i) ")), mark
    assert levels.stack == [("x.", (2,))] and not levels.goes_on("(d) ")
    levels.enter("2.1. ")
    assert levels.goes_on("2.2. ") and levels.goes_on("3. ") and not levels.goes_on("3.2. ")
    text = "(a) one is fine? (b) two is not? (z) three."
    assert [text[s:e] for s, e in sentences.sentences(text)] == ["(a) one is fine?", "(b) two is not?", "(z) three."]


@pytest.mark.parametrize("unit", ["(", '"„“', "«(]»", "a.", "x. ", "No. ", "1. A ", "«a.  ", "A.b", "...!", "กก ", "z. B. ", "@x.Y", "\n", " .", "(a) ", "“a.” ", "Art.", "No.", "no.A"])
def test_time_is_linear(unit):
    text = unit * (1_000_000 // len(unit))
    began = time.perf_counter()
    sentences.sentences(text)
    assert time.perf_counter() - began < 20


def test_a_megabyte_of_unmatched_marks():
    began = time.perf_counter()
    sentences.sentences("([{«„" * 200_000)
    assert time.perf_counter() - began < 6  # one to two seconds on an idle machine


def test_units_and_blank_lines(spark):
    text = "﻿CHAPTER 2 - X\r\n \r\nA line\nwraps here. B.S. is\none.\n\nA | 1.5 | x. Y\nB | 2 | z! W\n\n\n\nend"
    want = ["CHAPTER 2 - X", "A line\nwraps here.", "B.S. is\none.", "A | 1.5 | x. Y\nB | 2 | z! W", "end"]
    assert [text[s:e] for s, e in sentences.sentences(text)] == want
    df = spark.createDataFrame([(1, text, 0), (2, None, 0), (3, "", 0), (4, " \n\n﻿ ", 0), (5, "😀 end. Begin", 0)], "doc_id bigint, text string, sent_start int")
    got = sentences.sentence_units(df, "doc_id", "text").collect()
    assert {(r["doc_id"], r["sent_start"], r["sent_end"]) for r in got if r["doc_id"] != 1} == {(5, 0, 6), (5, 7, 12)}
    assert sum(r["doc_id"] == 1 for r in got) == len(want)


def test_sentences_touch_and_cover():
    assert [(0, 8), (8, 16)] == sentences.sentences("It ends.Next one")
    rnd = random.Random(6)
    for _ in range(500):
        t = "".join(rnd.choices(list("aB.。!?\"“”«»()（）「」„ \n\n1 กब।") + ["Dr. ", "...", "3. Mai "], k=rnd.randint(0, 60)))
        out = sentences.sentences(t)
        assert all(a < b and not t[a].isspace() and not t[b - 1].isspace() for a, b in out)
        assert all(b <= c for (_, b), (c, _) in zip(out, out[1:]))
        assert "".join(t.split()) == "".join("".join(t[a:b].split()) for a, b in out)


def test_word_hashes_of_joined_texts():
    import re

    texts = ["Ab cd_e é1", "", "  ", "x", "हिन्दी का"]
    h, bounds = kernel.word_hashes(texts)
    assert [int(n) for n in bounds[1:] - bounds[:-1]] == [len(re.findall(r"\w+", t)) for t in texts]
    assert len(set(h.tolist())) == len({w for t in texts for w in re.findall(r"\w+", t.lower())})
