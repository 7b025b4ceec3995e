import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from epigrain.llm.packing import cuts, pack, tail_lengths
from epigrain.llm.shared import new_folder
from epigrain.llm.token_files import FrameReader, read_digests, read_documents, token_digests, write_token_files
from epigrain.llm.token_ids import PieceEncoder

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
TRICKY = [" ", " ", "\n", "\t", "a", "b", "É", "1", ".", "'s", "\x1c", "  ", "́", "<|endoftext|>", "漢", "😀", "\r\n", "Σ", " ", "|"]


def plain_ids(path, texts):
    made = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
    return [np.array(e.ids, "<u4") for e in made]


@pytest.mark.parametrize("path,keeps_space", [(BYTE, True), (WORD, False)])
def test_pieces_give_the_ids_of_whole_texts(path, keeps_space):
    draw = random.Random(7)
    texts = ["".join(draw.choice(TRICKY) for _ in range(draw.randint(0, 30))) for _ in range(3000)]
    texts += ["one two \0three four", "three", "\0three", "a \0", "\0 \0a", "Word, word. WORD!! ÉCOLE, école; it's, 's. #Ab &ab"]
    texts += ["".join(draw.choice(["Ab", "ab", "É", "é", ",", "!!", ".", "'", " ", " ", "\0", "1", "ſ", "×"]) for _ in range(20)) for _ in range(2000)]
    texts += ["", " ", "\n", None, "word " * 500, "x" * 5000, "Some words, and more words.\nA line. " * 20]
    encoder = PieceEncoder(path, keeps_space)
    for _ in range(2):  # the second time from the kept pieces
        assert encoder.encode(texts) == [x.tobytes() for x in plain_ids(path, texts)]


def rows_of(documents):
    texts = ["A first text. With words", None, "", "word " * 3000, "same text", "same text", "Été à l'école\n" * 40]
    return documents([(i * 7 % 11, t) for i, t in enumerate(texts)] + [(3, "again"), (None, "no id")])


def test_token_files_round_trip(spark, documents):
    docs = rows_of(documents)
    got = [tuple(r) for r in token_digests(docs, BYTE, 2).collect()]
    rows = sorted([(r.doc_id, r.text) for r in docs.collect()], key=lambda r: (r[0] is not None, r[0] or 0))
    want = [(i, np.append(x, 2).astype("<u4")) for (i, _), x in zip(rows, plain_ids(BYTE, [t for _, t in rows]))]
    got.sort(key=lambda r: r[1])
    assert sorted(((r[0], r[2], r[3]) for r in got), key=repr) == sorted(
        ((i, len(x), zlib.crc32(x.tobytes())) for i, x in want), key=repr
    )
    assert [r[0] for r in got] == [i for i, _ in want]
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_only_asked_frames_are_read_and_damage_is_seen(spark, documents):
    docs = documents([(i, f"text number {i} " * 20) for i in range(200)])
    folder = new_folder(spark, "t")
    files = write_token_files(docs, folder, BYTE, 2, frame_tokens=500)
    got = {r.doc_id: r.ids for r in read_documents(files, folder, [3, 150, 999]).collect()}
    assert sorted(got) == [3, 150]
    assert got[150] == [*plain_ids(BYTE, ["text number 150 " * 20])[0].tolist(), 2]
    name = f"{folder}/{files.first().file}"
    reader = FrameReader(name)
    assert len(reader.table) > 3 and [d[0] for d in reader.only([int(reader.index[1][0])])] and reader.frames_read == 1
    path = name.removeprefix("file:")
    raw = bytearray(open(path, "rb").read())
    at = int(reader.at[0]) + 25
    raw[at : at + 40] = bytes(40)
    open(path, "wb").write(raw)
    with pytest.raises(Exception):
        read_digests(files, folder).collect()


def test_token_files_of_an_empty_table(documents, spark):
    assert token_digests(documents([]), BYTE, 2).count() == 0


@pytest.mark.parametrize("capacity", [64, 2048])
def test_cuts_are_whole_and_tight(capacity):
    for n in range(1, 3 * capacity):
        parts = cuts(n, capacity)
        assert sum(parts) == n and min(parts) >= 1 and max(parts) <= capacity
    assert sum(tail_lengths(5 * capacity - 3, capacity)) == 5 * capacity - 3


def test_packing_places_every_id_once(documents):
    docs = rows_of(documents).unionByName(documents([(100 + i, "filler words here " * (i * 37 % 900)) for i in range(60)]))
    rows = pack(docs, WORD, 1, 2048, with_ids=True).collect()
    sequences = {}
    for r in rows:
        assert r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
        sequences.setdefault(r.sequence_id, []).append(r)
    for parts in sequences.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == [0, *np.cumsum([p.length for p in parts])[:-1].tolist()]
        assert sum(p.length for p in parts) == parts[0].sequence_tokens <= 2048
    pieces = {}
    for r in rows:
        pieces.setdefault((r.doc_id, r.doc_tokens), []).append(r)
    source = [(r.doc_id, r.text) for r in docs.collect()]
    want = sorted(((i, tuple([*x.tolist(), 1])) for (i, _), x in zip(source, plain_ids(WORD, [t for _, t in source]))), key=repr)
    got = []
    for (doc_id, total), parts in pieces.items():
        starts = sorted(parts, key=lambda r: r.start)
        copies = sum(p.start == 0 for p in starts)
        assert sum(p.length for p in starts) == copies * total
        if copies == 1:
            got.append((doc_id, tuple(x for p in starts for x in p.ids)))
    assert set(got) <= set(want) and len(got) >= len(want) - 4
    lengths = [p[0].sequence_tokens for p in sequences.values()]
    padding = sum(2048 - n for n in lengths if n & (n - 1))
    assert padding < 0.02 * sum(lengths)


def test_packing_of_an_empty_table(documents):
    assert pack(documents([]), WORD, 1).count() == 0
