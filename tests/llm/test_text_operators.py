import base64

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from latticeworks.llm import encode, leakage, split
from latticeworks.llm.tokens import PATTERN, VOCABULARY, codec, read_ranks, serialise

TEXTS = ["", None, "a", "Hello world", "  spaced   out \n\n\n text\t", "it's we'll THEY'D 's", "ünïcödé ß 中文字符 🙂👩‍🔬 ½ ² x₂", "<|endoftext|> is text", "\x00\x1c\x85 ", "é" * 700, "word " * 3000, "x" * 5000]


@pytest.fixture(scope="module")
def reference():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(VOCABULARY, "rb"))}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def corpus(spark, texts=TEXTS):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id bigint, text string, ids string, piece int")


def test_ids_equal_the_reference(spark, reference):
    got = {r["doc_id"]: r["ids"] for r in encode.encode_corpus(corpus(spark)).collect()}
    assert got == {i: reference.encode_ordinary(t or "") for i, t in enumerate(TEXTS)}


def test_round_trip_and_empty_table(spark):
    df = corpus(spark)
    back = {r["doc_id"]: r["text"] for r in encode.decode_corpus(encode.encode_corpus(df)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}
    assert encode.encode_corpus(df.where("false")).collect() == []


def test_null_and_repeated_keys_stay(spark):
    df = spark.createDataFrame([(None, "a"), (1, "a"), (1, "a")], "doc_id bigint, text string")
    assert encode.encode_corpus(df).count() == 3


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text(reference, text):
    text = text.encode("utf-8", "ignore").decode()
    assert codec().encode(text) == reference.encode_ordinary(text)
    assert codec().decode(codec().encode(text)) == text


def test_every_character_is_cut_as_by_the_pattern():
    import regex

    whole, c = regex.compile(PATTERN), codec()
    for k in [*range(0x3000), *range(0xFE00, 0xFFFF, 7), *range(0x1D400, 0x1D800, 5), *range(0x1F300, 0x1FA00, 11)]:
        s = f"a{chr(k)}1 {chr(k)}b. {chr(k)}'s"
        assert whole.findall(s) == c.pretokens(s), hex(k)


def test_ranks_with_gaps_are_refused():
    with pytest.raises(ValueError, match="gaps"):
        serialise({b"a": 0, b"b": 2})
    assert len(read_ranks()) == 50256


def pieces_of(spark, texts, **kw):
    out = {}
    for r in split.split_texts(corpus(spark, texts), **kw).orderBy("doc_id", "piece").collect():
        out.setdefault(r["doc_id"], []).append(r)
    return out


def test_pieces_cover_the_text(spark, reference):
    got = pieces_of(spark, TEXTS)
    assert set(got) == set(range(len(TEXTS)))
    for i, rows in got.items():
        t = TEXTS[i] or ""
        n = len(reference.encode_ordinary(t))
        assert rows[0]["first_token"] == 0
        assert rows[-1]["end_token"] == n
        assert rows[-1]["end_char"] == len(t)
        assert (len(rows) > 1) == (n > 512)
        for a, b in zip(rows, rows[1:], strict=False):
            assert a["end_token"] - b["first_token"] == 32
            assert b["first_char"] <= a["end_char"]
        assert all(r["end_token"] - r["first_token"] <= 512 for r in rows)
        assert "".join([t[rows[0]["first_char"] : rows[0]["end_char"]], *[t[a["end_char"] : b["end_char"]] for a, b in zip(rows, rows[1:], strict=False)]]) == t


def test_cuts_prefer_coarse_boundaries(spark):
    sentence = "The sample was heated slowly to a high temperature. "
    texts = ["\n\n".join([sentence * 30] * 4), sentence * 200, "word " * 2000, "\n".join(["alpha beta gamma"] * 600), "x7" * 3000]
    cuts = {i: {r["cut"] for r in rows[:-1]} for i, rows in pieces_of(spark, texts).items()}
    assert cuts == {0: {"paragraph"}, 1: {"sentence"}, 2: {"word"}, 3: {"line"}, 4: {"part"}}
    for i, rows in pieces_of(spark, texts).items():
        for r in rows[:-1]:
            if r["cut"] in ("sentence", "word"):
                assert texts[i][: r["end_char"]].rstrip() == texts[i][: r["end_char"]] or texts[i][r["end_char"]] not in " \n"


def test_one_endless_word_is_cut_hard_between_characters(spark):
    t = "🙂é" * 2000
    rows = pieces_of(spark, [t])[0]
    assert len(rows) > 1
    assert all(t[r["first_char"] : r["end_char"]] for r in rows)


def test_split_parameters(spark):
    with pytest.raises(ValueError, match="overlap"):
        split.split_texts(corpus(spark), limit=10, overlap=10)
    assert split.split_texts(corpus(spark).where("false")).collect() == []
    assert {r["doc_id"] for r in split.oversized(corpus(spark)).collect()} == {i for i, t in enumerate(TEXTS) if len(codec().encode(t or "")) > 512}


WORDS = [f"term{i}" for i in range(400)]


def item(k, n=60):
    return " ".join(WORDS[(k * 37 + i * 7) % 400] for i in range(n))


def brute(items, docs):
    """Dynamic programming over all intervals: whether 20 words or more with one change in ten occur."""
    known, found = leakage.Items(items), set()
    for d, t in docs:
        w = [known.terms.get(x, 0) for x in leakage.words(t)]
        for k, part in enumerate(known.parts):
            part = part.tolist()
            hit = False
            for a in range(len(part) - 19):
                row = [0] * (len(w) + 1)  # edits of an interval that starts at a and ends before the current item word
                for i in range(a, min(len(part), a + 40)):
                    new = [row[0] + 1]
                    for j in range(1, len(w) + 1):
                        new.append(min(row[j - 1] + (part[i] != w[j - 1]), row[j] + 1, new[j - 1] + 1))
                    row = new
                    n = i - a + 1
                    if n >= 20 and min(row) * 10 <= n:
                        hit = True
                if hit:
                    break
            if hit:
                found.add((d, known.ids[k]))
    return found


def test_leaks_equal_brute_force(spark):
    stock = " Choose the best option and explain your choice in one sentence."
    items = [(i, item(i).capitalize() + "." + (stock if i < 4 else "")) for i in range(6)] + [(6, None), (7, "short"), (8, "")]
    a, b, c = item(0).split(), item(1).split(), item(2).split()
    changed, dropped, added = list(a[5:35]), list(b[:24]), list(c[10:34])
    changed[10], changed[20] = "other", "thing"
    del dropped[8]
    added.insert(9, "extra")
    docs = {
        1: " ".join(a[3:25]),
        2: "filler " * 9 + " ".join(changed) + " filler",
        3: " ".join(dropped),
        4: " ".join(added),
        5: " ".join(a[:17]) + " nothing else",
        6: stock * 3,
        7: " ".join(w.upper() for w in b[20:45]).replace(" ", "\r\n> ", 7),
        8: " ".join(f"**{w}**" for w in c[:25]),
        9: "".join(chr(ord(x) + 0xFEE0) if x.isalnum() else x for x in " ".join(a[:22])),
        10: " ".join(w[:3] + "\xad" + w[3:] for w in b[:22]),
        11: " ".join(w[:3] + "-\n" + w[3:] for w in c[:22]) + " é",
        12: None,
        13: "",
        14: " ".join(x for i, x in enumerate(a[:40]) if i % 5),
        15: " ".join(a[3:25]),
    }
    df = spark.createDataFrame([(k, v, 0) for k, v in docs.items()], "doc_id bigint, text string, item_id int")
    ev = spark.createDataFrame(items + items[:2], "item_id bigint, text string").selectExpr("item_id", "text", "1 AS doc_id")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, ev).collect()}
    want = brute(items, list(docs.items()))
    assert want >= {(1, 0), (2, 0), (3, 1), (4, 2), (7, 1), (8, 2), (9, 0), (10, 1), (11, 2), (15, 0)}
    assert not {(5, 0), (6, 0), (14, 0)} & want
    assert got == want


def test_changes_at_the_ends_of_a_passage_count(spark):
    items = [(0, item(0)), (1, item(1, 20))]
    a, b = item(0).split(), item(1, 20).split()
    docs = {
        1: " ".join([*b[:19], "other"]),
        2: " ".join(["other", *b[1:19], "other"]),
        3: " ".join(b[2:]),
        4: " ".join(b[3:]),
        5: " ".join(["other", *a[11:29], "other"]),
        6: " ".join(["other", *a[11:28], "other"]),
        7: " ".join(["other", *b[1:9], "extra", *b[9:]]),
        8: " ".join(["other", *b[1:9], "extra", *b[9:19], "other"]),
        9: " ".join(x for i, x in enumerate(a[:40]) if i % 8),
        10: " ".join(["other", *a[5:14], "other", *a[15:33], "other"]),
    }
    df = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leakage.leaks(df, spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert got == brute(items, list(docs.items()))
    assert got >= {(1, 1), (2, 1), (3, 1), (5, 0), (7, 1), (9, 0), (10, 0)}
    assert not {(4, 1), (6, 0), (8, 1)} & got


def test_leaks_of_nothing(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    ev = spark.createDataFrame([(1, item(1))], "item_id bigint, text string")
    assert leakage.leaks(df, ev.where("false")).collect() == []
    assert leakage.leaks(df.where("false"), ev).collect() == []


def test_words():
    assert leakage.words("Edge-sharing <b>tie-\nline</b> don't É ﬁne Ｍｇ₂ а1b") == [b"edgesharing", b"tieline", b"dont", b"e", b"fine", b"mg2", b"a1b"]


def test_cut_kinds():
    t = "One. Two\nThree\n\nFour five"
    c = codec()
    ends = np.cumsum([len(w) for w in c.pretokens(t)])
    kinds = dict(zip(ends.tolist(), split.cut_kinds(t, ends).tolist(), strict=True))
    assert kinds[4] == 2
    assert kinds[9] == 1
    assert kinds[16] == 0
    assert kinds[20] == 3
