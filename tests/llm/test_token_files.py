import io
import random
import zlib

import numpy as np
import pytest
import xxhash
import zstandard

from tallyloom.llm import token_files as tf

TEXTS = ["", " ", "  two  spaces ", "a\n\n b\t c", "It's they'll I'D", "naïve façade — “x” 😀 中文 字", "1234 5,678.90", "  x  y", "<|endoftext|> in text", "tab\tend ", "x" * 3000, "é" * 500, "　wide", "a \n b", "trailing \n"]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tf.vocabulary_path())
    return lambda text: t.encode(text, add_special_tokens=False).ids


def test_cuts_give_the_librarys_ids(library):
    encoder = tf.Encoder(tf.vocabulary_path())
    assert encoder.by_cuts
    rng = random.Random(3)
    stock = [" ", "  ", "\n", "\t", "a", "Word", "été", "don't", "12", "!!", " ", "😀", "ß", "--", " ", "'s", "x1", "\r\n", "中"]
    made = TEXTS + ["".join(rng.choice(stock) for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for text in made:
        assert encoder.ids(text).tolist() == library(text), repr(text)


def brute(rows, library):
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start, out = 0, []
    for d, text in ordered:
        ids = np.array([*library(text or ""), tf.END_ID], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize(("file_ids", "file_docs"), [(tf.FILE_IDS, tf.FILE_DOCS), (60, 10_000), (10**9, 2)])
def test_files_closed_by_size(make, words, tmp_path, library, file_ids, file_docs):
    rows = [(None if i % 3 == 0 else i % 7, words(i % 40, i)) for i in range(90)] + [(5, "<|endoftext|>"), (None, "<|endoftext|>")]
    where = f"file://{tmp_path}/t"
    manifest = tf.write_tokens(make(rows), where, frame_ids=50, file_ids=file_ids, file_docs=file_docs)
    got = [tuple(r) for r in tf.digests(manifest, where).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows, library)
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.start, len(r.ids)) for r in tf.read_tokens(manifest, where).collect()) == sorted((r[0] is not None, r[0] or 0, r[1], r[2]) for r in got)
    if file_docs == 2:
        assert max(r.n_docs for r in manifest.collect()) == 2


def test_an_encoder_that_remembers_little(make, words, tmp_path, library):
    rows = [(i, words(40, i)) for i in range(60)]
    where = f"file://{tmp_path}/t"
    got = [tuple(r) for r in tf.digests(tf.write_tokens(make(rows), where, words=50), where).collect()]
    assert sorted(got, key=lambda r: r[1]) == brute(rows, library)


def seekable(raw):
    """The data of a file in the public seekable format, by its definition alone."""
    assert raw[-4:] == (0x8F92EAB1).to_bytes(4, "little") and raw[-5] == 0x80
    n = int.from_bytes(raw[-9:-5], "little")
    table = raw[len(raw) - 9 - 12 * n - 8 :]
    assert table[:4] == (0x184D2A5E).to_bytes(4, "little") and int.from_bytes(table[4:8], "little") == 12 * n + 9
    at, out = 0, b""
    for i in range(n):
        packed, size, check = (int.from_bytes(table[8 + 12 * i + 4 * k :][:4], "little") for k in range(3))
        frame = raw[at : at + packed]
        data = zstandard.ZstdDecompressor().decompress(frame, max_output_size=size) if size else b""
        assert len(data) == size and check == xxhash.xxh64_intdigest(data) & 0xFFFFFFFF
        at, out = at + packed, out + data
    assert at == len(raw) - len(table)
    return out


def test_the_public_seekable_format_can_be_read():
    lists = [list(range(i % 13)) for i in range(60)] + [[], []]
    assert np.frombuffer(seekable(a_file(lists)), "<u4").tolist() == [x for own in lists for x in own]
    assert seekable(a_file([])) == b"" and tf.FrameReader(Watched(a_file([[], [5], []]))).document(2).tolist() == []


def test_files_of_odd_rows(odd, spark, tmp_path, library):
    docs, rows = odd
    where = f"file://{tmp_path}/t"
    manifest = tf.write_tokens(docs, where, frame_ids=50)
    got = [tuple(r) for r in tf.digests(manifest, where).collect()]
    key = lambda r: (r[0] is not None, r[0] or 0, r[1])
    assert sorted(got, key=key) == brute(rows, library)
    sums = manifest.groupBy().sum("n_docs", "n_tokens").first()
    assert (sums[0], sums[1]) == (len(rows), sum(r[2] for r in got))


def test_empty_table(make, tmp_path):
    where = f"file://{tmp_path}/t"
    assert tf.digests(tf.write_tokens(make([]), where), where).count() == 0


class Watched(io.BytesIO):
    reads = 0

    def size(self):
        return len(self.getbuffer())

    def read(self, n=-1):
        self.reads += 1
        return super().read(n)


def a_file(lists, frame_ids=10):
    out = io.BytesIO()
    writer = tf.FrameWriter(out, frame_ids)
    for i, ids in enumerate(lists):
        writer.add(i, np.array(ids, np.uint32))
    writer.close()
    return out.getvalue()


def test_reader_unpacks_only_what_is_asked_for():
    lists = [[i] * (i % 7) for i in range(100)]
    source = Watched(a_file(lists))
    reader = tf.FrameReader(source)
    before = source.reads
    assert reader.document(50).tolist() == lists[50] and source.reads == before + 1
    assert [reader.document(i).tolist() for i in range(100)] == lists
    assert reader.find(33) == [33] and reader.find(1000) == []


def test_plain_tools_see_the_ids_and_damage_is_noticed():
    lists = [[1, 2, 3], [70_000] * 25, []]
    raw = a_file(lists)
    plain = b""
    rest = raw
    while rest:  # frame by frame; skippable frames give nothing
        if rest[1:4] == b"\x2a\x4d\x18":
            rest = rest[8 + int.from_bytes(rest[4:8], "little") :]
            continue
        d = zstandard.ZstdDecompressor().decompressobj()
        plain += d.decompress(rest)
        rest = d.unused_data
    assert np.frombuffer(plain, "<u4").tolist() == [x for own in lists for x in own]
    reader = tf.FrameReader(Watched(raw))
    reader.seeks = reader.seeks.copy()
    reader.seeks["check"][0] ^= 1
    with pytest.raises(ValueError, match="checksum"):
        reader.document(0)
    with pytest.raises(ValueError, match="seek table"):
        tf.FrameReader(Watched(raw[:-1] + b"\0"))
