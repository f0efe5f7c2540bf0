from __future__ import annotations

import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from textmill.llm import chat, media, packing
from textmill.llm.pieces import Pieces, encode_pieces, piece_digests

RANKS = P.path("byte_bpe_50k.tiktoken")
MODEL = P.path("piece_bpe_32k.model")


def odd_texts(n=3000):
    rng = random.Random(2)
    alphabet = " " * 8 + "▁\t\nabcdeéñ1234<s></s>\0ａ中文😀​.,'|endoftext"
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(n)] + ["", " ", "  ", "a" * 3000, "<unk>", "<0x0A>", "<|endoftext|>"]


def test_ids_equal_those_of_the_tokenizers_file(corpus):
    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    ours = packing.encoder(RANKS, P.PATTERN)
    texts = odd_texts() + [r[1] or "" for r in corpus]
    assert [ours(t) for t in texts] == [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]


def test_added_tokens_inside_texts(spark):
    reference = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = ["a <|endoftext|> b", "<|endoftext|><|endoftext|>", " <|endoftext|>\n\n x", "<|endoftext|", "é<|endoftext|>é", "x" * 300 + "<|endoftext|>"] + odd_texts()
    expected = [e.ids for e in reference.encode_batch(texts, add_special_tokens=False)]
    assert expected[0] == [64, 220, 50256, 275]
    ours = packing.encoder(RANKS, P.PATTERN)
    assert [ours(t) for t in texts] == expected
    rows = packing.pack(spark.createDataFrame(list(enumerate(texts[:6])), "doc_id long, text string"), RANKS, P.PATTERN, with_ids=True).collect()
    assert {r["doc_id"]: list(r["ids"]) for r in rows} == {i: [*e, 1] for i, e in enumerate(expected[:6])}


def test_packing_holds_each_id_once(docs, corpus):
    rows = packing.pack(docs, RANKS, P.PATTERN, capacity=256, per_group=20, with_ids=True).collect()
    encode = packing.encoder(RANKS, P.PATTERN)
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r["doc_id"], []).append(r)
        sequences.setdefault(r["sequence_id"], []).append(r)
        raw = np.array(r["ids"], "<u4")
        assert (r["length"], r["ids_crc32"]) == (len(raw), zlib.crc32(raw.tobytes()))
    for doc_id, text, *_ in corpus:
        own = sorted(pieces[doc_id], key=lambda r: r["start"])
        ids = [i for r in own for i in r["ids"]]
        assert ids == [*encode(text or ""), 1] and {r["doc_tokens"] for r in own} == {len(ids)}
        assert [r["start"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]]))
    for own in sequences.values():
        own.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in own] == list(np.cumsum([0] + [r["length"] for r in own[:-1]])) and sum(r["length"] for r in own) <= 256
    assert sum(r["length"] for r in rows) / (256 * len(sequences)) > 0.85


def test_groups_follow_bytes_not_documents(spark, tmp_path):
    """Few documents of very many tokens make many groups; pieces of one long document are in many of them."""
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("aeionrst") for _ in range(7))
    texts = [" ".join(word() for _ in range(150_000)) for _ in range(4)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "few"))
    few = spark.read.parquet(str(tmp_path / "few"))
    groups, tasks = packing.group_and_task_count(few, group_bytes=100_000)
    assert groups > 20 and 4 <= tasks <= groups
    rows = packing.pack(few, RANKS, P.PATTERN).collect()
    assert len({r["sequence_id"] >> 32 for r in rows if r["doc_id"] == 0}) > 1
    encode = packing.encoder(RANKS, P.PATTERN)
    assert {r["doc_id"]: r["doc_tokens"] for r in rows} == {i: len(encode(t)) + 1 for i, t in enumerate(texts)}
    assert sum(r["length"] for r in rows) == sum(len(encode(t)) + 1 for t in texts)


def test_differencing_is_level_and_complete():
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 1025, 600)
    window = packing.pack_sizes(sizes, 2048)
    sums = np.bincount(window, weights=sizes)
    assert sums.max() <= 2048 and sizes.sum() / (2048 * len(sums)) > 0.97
    assert packing.pack_sizes(np.array([], int), 10).tolist() == [] and packing.pack_sizes(np.array([10, 10, 1]), 10).max() == 2
    level = np.bincount(packing.differencing(np.arange(1, 101), 7), weights=np.arange(1, 101))
    assert level.max() - level.min() <= 2
    with pytest.raises(ValueError, match="longer"):
        packing.pack_sizes(np.array([11]), 10)


def test_packing_edge_rows(spark, none):
    assert packing.pack(none, RANKS, P.PATTERN).count() == 0
    rows = spark.createDataFrame([(1, None, 5), (1, None, 5), (None, "", 6)], "doc_id long, text string, offset int")
    out = packing.pack(rows, RANKS, P.PATTERN).collect()
    assert [r["length"] for r in out] == [1, 1, 1] and {r["sequence_id"] for r in out} == {out[0]["sequence_id"]} and sorted(r["offset"] for r in out) == [0, 1, 2]


@pytest.mark.parametrize("table_size", [100_000, 50])
def test_pieces_equal_the_library(table_size, corpus):
    pieces = Pieces(MODEL, table_size)
    assert pieces.split
    texts = odd_texts() + [r[1] or "" for r in corpus]
    expected = pieces.sp.encode(texts, add_bos=True, add_eos=True)
    assert pieces.encode(texts) == expected
    assert pieces.decode(expected) == pieces.sp.decode(expected)


def test_piece_rows(spark, docs, corpus, none):
    sp = Pieces(MODEL).sp
    rows = {r["doc_id"]: r for r in piece_digests(docs, MODEL).collect()}
    for doc_id, text, *_ in corpus:
        ids = sp.encode(text or "", add_bos=True, add_eos=True)
        assert rows[doc_id]["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest() and rows[doc_id]["n_tokens"] == len(ids)
        assert rows[doc_id]["decoded_sha256"] == hashlib.sha256(sp.decode(ids).encode()).hexdigest()
    assert piece_digests(none, MODEL).count() == 0
    both = encode_pieces(spark.createDataFrame([(1, "a b", 3), (1, "a b", 3), (2, None, 4)], "doc_id long, text string, ids int"), MODEL).collect()
    assert sorted(r["decoded"] for r in both) == ["", "a b", "a b"]


def test_media_round_trip(spark, docs, corpus, none):
    rows = {r["doc_id"]: r for r in media.from_media(media.to_media(docs)).collect()}
    for doc_id, text, *_ in corpus:
        n, payload = media.payload_of(text)
        r = rows[doc_id]
        assert (r["n_bytes"], bytes(r["payload"])) == (n, payload) and len(payload) % 64 == 0 and "crc=" in r["feature"]
    assert media.from_media(media.to_media(none)).count() == 0
    twice = media.from_media(media.to_media(spark.createDataFrame([(1, "t", b"x"), (1, "t", b"y")], "doc_id long, text string, media binary"))).collect()
    assert twice[0] == twice[1]


@pytest.mark.parametrize("n", [64, 128, 1344, 1408, 6400, 100_032])
def test_media_parser(n):
    rng = random.Random(n)
    for payload in (rng.randbytes(n), b"\xff" * n, b"\xff\xfa\xe8\xc0" * (n // 4)):
        stream = media.write_stream(payload)
        info = media.read_stream(stream)
        assert info["payload"] == payload and info["skipped"] == info["bad_crc"] == 0
        assert info["vbr"]["frames"] == info["frames"] == len(info["offsets"]) and info["vbr"]["bytes"] == len(stream) - info["tag_bytes"]
        assert media.exact_duration(info) == media.exact_duration({"samples": 1152 * info["frames"], "sample_rate": 32000})
        damaged = bytearray(stream)
        damaged[info["offsets"][-1] + 8] ^= 1
        assert media.read_stream(bytes(damaged))["bad_crc"] == 1
        if info["frames"] > 3:
            at = info["offsets"][2]
            again = media.read_stream(stream[:at] + b"noise\xff\xfbnoise" + stream[at:])
            assert again["payload"] == payload and again["skipped"] == 12 and again["resyncs"] >= 1
    assert media.read_stream(b"")["frames"] == 0 and media.read_stream(rng.randbytes(300))["payload"] is not None


@pytest.mark.parametrize("n", [65, 100, 128, 1300, 1417, 1500, 3000])
def test_media_text_that_looks_like_a_tag(n):
    """TAG at each place of the text, so also 128 bytes before the end of the stream."""
    for at in range(max(0, n - 1500), n - 2):
        _, payload = media.payload_of("a" * at + "TAG" + "b" * (n - at - 3))
        info = media.read_stream(media.write_stream(payload))
        assert (info["payload"], info["skipped"], info["vbr"]["frames"]) == (payload, 0, info["frames"]), at


@pytest.mark.parametrize("n", [64, 128, 1344, 6400])
def test_media_tag_behind_the_frames(n):
    tag = b"TAG" + b"\xff\xfa\xe8\xc0title".ljust(125, b"\xff")
    payload = random.Random(n).randbytes(n)
    stream = media.write_stream(payload)
    clean = media.read_stream(stream)
    for between in (b"", b"noise\xffnoise"):
        info = media.read_stream(stream + between + tag)
        assert (info["payload"], info["offsets"], info["skipped"]) == (payload, clean["offsets"], len(between))
    short = media.read_stream(stream[:-30] + tag)  # a last frame without its end does not take the tag's bytes
    assert short["offsets"] == clean["offsets"][:-1]


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def test_chat_round_trip(spark):
    rng = random.Random(4)
    alphabet = "ab\\#<: \n/turn>é😀"
    rows = [(c, t, rng.choice(["user", "assistant", "system", "odd: #role"]), rng.choice([None, "", "".join(rng.choice(alphabet) for _ in range(30)), "\\### Assistant: </turn> ok"])) for c in range(6) for t in range(rng.choice([1, 3, 200]))]
    rows += [(6, 0, None, "no role"), (None, 0, "assistant", "null id"), (7, 1, "user", "tie b"), (7, 1, "user", "tie a")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).repartition(4)
    out = {r["conv_id"]: r for r in chat.read_back(chat.format_chats(frame)).collect()}
    for conv in {r[0] for r in rows}:
        turns = [(r or "", t or "") for _, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: (x[1], x[2] or "", x[3] or ""))]
        under = "".join(t for r, t in turns if r == "assistant")
        r = out[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r["loss_chars"], r["loss_sha256"], r["formatted_chars"]) == (len(under), sha(under), len(chat.default_render(turns)))
    assert chat.format_chats(frame.limit(0)).count() == 0


def test_templates_as_black_boxes():
    turns = [("user", " x"), ("assistant", ""), ("user", "A"), ("assistant", "B </turn>")] * 40
    opened = chat.locate(lambda ts: "<s>" + chat.default_render(ts), turns)
    assert [chat.unescape(opened.text[a:b]) for a, b in opened.bodies] == [t for _, t in turns] and not opened.rewrites
    assert "".join(opened.text[a:b] for a, b in opened.spans) == opened.text[3:]
    last_only = lambda ts: "".join(f"[{r}]{t if i >= len(ts) - 2 else ''};" for i, (r, t) in enumerate(ts))
    assert chat.locate(last_only, turns).rewrites and chat.locate(last_only, turns[:6]).rewrites
    assert not chat.locate(chat.default_render, []).rewrites


@pytest.mark.parametrize("n", [1, 14, 70, 130])
def test_templates_that_number_their_turns(n):
    turns = [(("user", "assistant")[i % 2], f"txt{i}" * (i % 3)) for i in range(n)]
    templates = {
        "number": lambda ts: "".join(f"[{i}]{t}\n" for i, (_, t) in enumerate(ts)),
        "bare number": lambda ts: "".join(f"{i}{t}\n" for i, (_, t) in enumerate(ts)),
        "turn before": lambda ts: "".join(f"{ts[i - 1][1] if i else ''}>{t};" for i, (_, t) in enumerate(ts)),
        "block": lambda ts: "".join(f"{i % 10}{t}|" for i, (_, t) in enumerate(ts)),
        "probe in marks": lambda ts: "".join(f"\ue0f1A{t}\ue0f1{i}" for i, (_, t) in enumerate(ts)),
    }
    for name, render in templates.items():
        found = chat.locate(render, turns)
        assert not found.rewrites and [found.text[a:b] for a, b in found.bodies] == [t for _, t in turns], name
    by_text = chat.locate(lambda ts: "".join(f"{len(t)}:{t}" for _, t in ts), [("user", "x" * 12), ("user", "y")])
    assert by_text.rewrites and by_text.bodies == []
