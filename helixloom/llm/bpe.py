"""BPE encoding and decoding with reuse of content-defined chunks.

A rolling hash over the last bytes cuts every text where its content says so, hence equal passages fall into equal chunks in any document.
Chunk hashes are counted over all documents. Chunks found twice or more are encoded once, in a table of distinct chunks, and
delivered to their occurrences by a join; what lies between them is encoded in place. A cut may fall inside a word: there the
neighbouring pieces are re-encoded together, with one more piece on either side until the ids of the outer pieces agree with
those already there.

For tokenizers that drop white space, whose tokens never cross it (such as word-level byte-pair files with word ends); the
constructor refuses others. A fixed bitmap of the repeated hashes (``BITMAP_LOG2`` bits) goes to all tasks; its false positives
only send a chunk through the table.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .common import Bitmap, write_table

CHUNK_LOG2 = 10  # mean bytes of a chunk
LEAST_CHUNK = 64
ROLL = 8
BITMAP_LOG2 = 26
MEMO = 1 << 17

_ROLL = np.array([[xxhash.xxh32_intdigest(bytes([b]), 31 + k) for b in range(256)] for k in range(ROLL)], np.uint32)
_WHITE = b" \t\n\x0b\x0c\r"
# a piece of Latin letters, with or without ASCII marks behind them (no apostrophe): one or two words to the tokenizer
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")


def byte_alphabet() -> dict[int, int]:
    """Characters by which byte-level vocabularies write bytes: printable ones stand for themselves, the others follow from 256 on."""
    printable = {b for b in range(256) if 33 <= b <= 126 or 161 <= b and b != 173}
    others = [b for b in range(256) if b not in printable]
    return {**{b: b for b in printable}, **{b: 256 + i for i, b in enumerate(others)}}


def cuts(data: bytes) -> list[int]:
    """Ends of the content-defined chunks; a cut never falls inside a character, the last one is the text's end."""
    n = len(data)
    if n <= ROLL:
        return [n] if n else []
    a = np.frombuffer(data, np.uint8)
    h = np.zeros(n - ROLL + 1, np.uint32)
    for k in range(ROLL):
        h += _ROLL[k][a[k:n - ROLL + 1 + k]]
    found, last = [], 0
    for c in (np.flatnonzero(h >> np.uint32(32 - CHUNK_LOG2) == 0) + ROLL).tolist():
        while c < n and data[c] & 0xC0 == 0x80:
            c += 1
        if c - last >= LEAST_CHUNK and c < n:
            found.append(c)
            last = c
    return found + [n]


Entry = tuple[tuple[int, ...], bytes, bytes]  # tuples of plain values, which the garbage collector doesn't visit


class Encoder:
    """A tokenizer with a bounded memo of white-space-delimited pieces."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        probe = [self.tokenizer.encode(t, add_special_tokens=False).ids for t in ("ab cd", "ab", "cd", "ab\n\t cd ")]
        if probe[0] != probe[1] + probe[2] or probe[3] != probe[0]:
            raise ValueError("tokens of this tokenizer depend on white space")
        self.joined_decode = spec.get("decoder") is None  # then decoding is the tokens joined by a space
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.kind = np.uint16 if size < 1 << 16 else np.uint32
        self.id_text = [str(i).encode() for i in range(size)]
        self.token = [(self.tokenizer.id_to_token(i) or "").encode() for i in range(size)]
        self.memo: dict[bytes, Entry] = {}
        self.words: dict[str, Entry] = {}
        self.older, self.older_words = {}, {}  # what the memos held before they were last full; entries still in use come back from there
        self.alphabet, self.model = byte_alphabet(), self.tokenizer.model
        probes = ["The", "thereonhe,", "ÉÀüß!!", "x.", "ŒǅȺ", "a###", "queeux&&&", "(b)"]
        self.plain = all(self._plain_ids(w) in (None, self.ids(w.encode())) for w in probes)  # does the short way give the tokenizer's ids?

    @classmethod
    def at(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def entry(self, ids: list[int]) -> Entry:
        if len(ids) == 1:
            return tuple(ids), self.id_text[ids[0]], self.token[ids[0]]
        return tuple(ids), b" ".join([self.id_text[i] for i in ids]), b" ".join([self.token[i] for i in ids])

    def ids(self, text: bytes) -> list[int]:
        return self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids

    def _word(self, word: str) -> Entry:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MEMO:
                self.older_words, self.words = self.words, {}
            found = self.older_words.get(word)
            if found is None:
                spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)  # visible ASCII is spelled as it is
                found = self.entry([t.id for t in self.model.tokenize(spelled)])
            self.words[word] = found
        return found

    def _plain_ids(self, piece: str) -> list[int] | None:
        e = self._plain_entry(piece)
        return list(e[0]) if e else None

    def _plain_entry(self, piece: str) -> Entry | None:
        """A piece of letters and marks straight by the model, without the tokenizer's general splitting; None for others."""
        if piece.isascii() and piece.isalpha():
            return self._word(piece.lower())
        m = _PLAIN.fullmatch(piece)
        if m is None:
            return None
        head = self._word(m[1].lower())
        if not m[2]:
            return head
        tail = self._word(m[2])
        return head[0] + tail[0], head[1] + b" " + tail[1], head[2] + b" " + tail[2]

    def pieces(self, data: bytes) -> list[Entry]:
        """(ids, ids as text, tokens as text) of each piece of a text."""
        words, memo = data.split(), self.memo
        found = list(map(memo.get, words))
        if None in found:
            new = list({w for w, e in zip(words, found) if e is None})
            older = self.older
            fresh = {w: e for w in new if (e := older.get(w) or self.plain and self._plain_entry(w.decode("utf-8", "replace")))}
            rest = [w for w in new if w not in fresh]
            for k in range(0, len(rest), 4096):
                part = rest[k:k + 4096]
                for w, e in zip(part, self.tokenizer.encode_batch([w.decode("utf-8", "replace") for w in part], add_special_tokens=False)):
                    fresh[w] = self.entry(e.ids)
            if len(memo) + len(fresh) > MEMO:
                self.older, self.memo = memo, fresh
            else:
                memo.update(fresh)
            found = [e or fresh[w] for w, e in zip(words, found)]
        return found

    def text_of(self, pieces) -> bytes:
        if self.joined_decode:
            return b" ".join([p[2] for p in pieces if p[0]])
        return self.tokenizer.decode([i for p in pieces for i in p[0]], skip_special_tokens=False).encode()


def chunk_key(chunk: bytes) -> bytes:
    return xxhash.xxh3_128_digest(chunk)


def _short(key: bytes) -> int:
    return int.from_bytes(key[:8], "big", signed=True)


def _binary(batch: pa.RecordBatch, name: str) -> list[bytes]:
    return [x or b"" for x in batch.column(name).cast(pa.binary()).to_pylist()]


def _count_chunks(batches):
    for b in batches:
        seen: Counter = Counter()
        for data in _binary(b, "_t"):
            s = 0
            for e in cuts(data):
                seen[_short(chunk_key(data[s:e]))] += 1
                s = e
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["h", "n"])


def _repeated(data: bytes, bitmap: Bitmap) -> list[tuple[int, int, bytes]]:
    """(start, end, key) of the chunks that other texts may have."""
    out, s = [], 0
    for e in cuts(data):
        key = chunk_key(data[s:e])
        if _short(key) in bitmap:
            out.append((s, e, key))
        s = e
    return out


PARTS = "doc_id long, uid string, blob binary, starts array<int>, keys array<binary>, chunk_key binary"


def _parts(bitmap):
    """Texts with repeated chunks, compressed, and those chunks, once for each batch."""

    def run(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for b in batches:
            rows, chunks = [], {}
            for i, data in zip(b.column("_id").to_pylist(), _binary(b, "_t")):
                if found := _repeated(data, bitmap.value):
                    rows.append((i, os.urandom(16).hex(), pack.compress(data), [s for s, _, _ in found], [k for _, _, k in found], None))
                    for s, e, k in found:
                        chunks.setdefault(k, data[s:e])
            rows += [(None, None, pack.compress(c), None, None, k) for k, c in chunks.items()]
            for k in range(0, len(rows), 2000):
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows[k:k + 2000]], t) for j, t in enumerate((pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.binary()), pa.binary()))], ["doc_id", "uid", "blob", "starts", "keys", "chunk_key"])

    return run


def _encode_chunks(path):
    def run(batches):
        enc, unpack = Encoder.at(path), zstandard.ZstdDecompressor()
        for b in batches:
            ids, counts = [], []
            for blob in b.column("blob").to_pylist():
                p = enc.pieces(unpack.decompress(blob))
                ids.append(np.array([i for x in p for i in x[0]], enc.kind).tobytes())
                counts.append(np.array([len(x[0]) for x in p], np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("chunk_key"), pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], ["chunk_key", "ids", "counts"])

    return run


def _stored(enc: Encoder, ids: bytes, counts: bytes) -> list[Entry]:
    flat, out, s = np.frombuffer(ids, enc.kind).tolist(), [], 0
    for n in np.frombuffer(counts, np.uint32).tolist():
        out.append(enc.entry(flat[s:s + n]))
        s += n
    return out


def join_runs(enc: Encoder, data: bytes, runs: list[tuple[int, int, list]]) -> list:
    """The pieces of a text from those of its consecutive runs (start, end, pieces), repaired at the joins."""
    out: list = []
    broken = 0  # start of the word that the last join has cut, if it has
    for k, (s, e, pieces) in enumerate(runs):
        cut_before = s > 0 and data[s - 1] not in _WHITE and data[s] not in _WHITE
        cut_after = e < len(data) and data[e - 1] not in _WHITE and data[e] not in _WHITE
        whole = len(data[s:e].split()) == 1
        if cut_before and cut_after and whole:
            continue  # inside one word
        if not cut_before:
            broken = -1
        if cut_before:
            stop = re.compile(rb"[\x20\x09-\x0D]|\Z").search(data, s).start()
            word = enc.ids(data[broken:stop])
            pieces = [enc.entry(word), *pieces[1:]]
            pieces = _agreed(enc, data[broken:stop], out, pieces, data, broken, stop)
        if cut_after:
            broken = max(data.rfind(bytes([c]), 0, e) for c in _WHITE) + 1
            pieces = pieces[:-1]
        out += pieces
    return out


def _agreed(enc: Encoder, word: bytes, left: list, pieces: list, data: bytes, start: int, stop: int) -> list:
    """Re-encode the repaired word with its neighbours, one more on either side each time, until the outer ones agree."""
    before, after = data[:start][-4096:].split(), data[stop:stop + 4096].split()
    if stop + 4096 < len(data) and after:
        after = after[:-1]  # may be cut
    k = 1
    while True:
        lo = [x for x in before[-k:]] if len(before) > k else []
        hi = after[:k] if k < len(pieces) and k <= len(after) else []
        ids = enc.ids(b" ".join([*lo, word, *hi]))
        want_lo = [i for p in (left[-len(lo):] if lo else []) for i in p[0]]
        want_hi = [i for p in pieces[1:1 + len(hi)] for i in p[0]]
        if ids[:len(want_lo)] == want_lo and ids[len(ids) - len(want_hi):] == want_hi:
            middle = ids[len(want_lo):len(ids) - len(want_hi)]
            return [enc.entry(middle), *pieces[1:]]
        if not lo and not hi:
            return [enc.entry(ids), *pieces[1:]]
        k += 1


Emit = Callable[[Encoder, list], tuple]


def full_rows(enc: Encoder, pieces: list) -> tuple:
    """Token ids and decoded text."""
    return [i for p in pieces for i in p[0]], enc.text_of(pieces).decode("utf-8", "replace")


def digests(enc: Encoder, pieces: list) -> tuple:
    """Number of tokens and digests of the ids' text and of the decoded text."""
    ids = b" ".join([p[1] for p in pieces if p[0]])
    return sum([len(p[0]) for p in pieces]), hashlib.sha256(ids).hexdigest(), hashlib.sha256(enc.text_of(pieces)).hexdigest()


FULL = (full_rows, [("ids", "array<int>", pa.list_(pa.int32())), ("decoded", "string", pa.string())])
DIGESTS = (digests, [("n_tokens", "long", pa.int64()), ("ids_sha256", "string", pa.string()), ("decoded_sha256", "string", pa.string())])


def _out(rows: list[tuple], columns) -> pa.RecordBatch:
    types = [pa.int64(), *[c[2] for c in columns]]
    return pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], ["doc_id", *[c[0] for c in columns]])


def _in_place(path, bitmap, emit, columns):
    """Texts without repeated chunks."""

    def run(batches):
        enc = Encoder.at(path)
        for b in batches:
            rows = []
            for i, data in zip(b.column("_id").to_pylist(), _binary(b, "_t")):
                if not _repeated(data, bitmap.value):
                    rows.append((i, *emit(enc, enc.pieces(data))))
                if len(rows) >= 500:
                    yield _out(rows, columns)
                    rows = []
            if rows:
                yield _out(rows, columns)

    return run


def _assemble(path, emit, columns):
    def run(batches):
        enc, unpack = Encoder.at(path), zstandard.ZstdDecompressor()
        for b in batches:
            rows = []
            for i, blob, starts, found in zip(*[b.column(c).to_pylist() for c in ("doc_id", "blob", "starts", "found")]):
                data = unpack.decompress(blob)
                ends = {}
                s = 0
                for e in cuts(data):
                    ends[s] = e
                    s = e
                runs, at = [], 0
                for c in sorted(found, key=lambda c: c["k"]):
                    s = starts[c["k"]]
                    if s > at:
                        runs.append((at, s, enc.pieces(data[at:s])))
                    runs.append((s, ends[s], _stored(enc, c["ids"], c["counts"])))
                    at = ends[s]
                if at < len(data):
                    runs.append((at, len(data), enc.pieces(data[at:])))
                rows.append((i, *emit(enc, join_runs(enc, data, runs))))
                if len(rows) >= 500:
                    yield _out(rows, columns)
                    rows = []
            if rows:
                yield _out(rows, columns)

    return run


def encode_documents(docs: DataFrame, path: str, output=FULL, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and the columns of ``output`` (token ids and decoded text by default), one row for each input row.

    Null and empty texts have no tokens and decode to the empty text. Repeated rows and null ids come out as often as they come in. A
    chunk that a third of all documents hold is encoded once; its occurrences are rows of a join that adaptive execution may split.
    """
    emit, columns = output
    spark = docs.sparkSession
    d = docs.select(F.col(f"`{id_col}`").cast("long").alias("_id"), F.col(f"`{text}`").alias("_t"))
    shared = d.select("_t").mapInArrow(_count_chunks, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1").select("h")
    bitmap = spark.sparkContext.broadcast(Bitmap.of(cut_lineage(shared), "h", BITMAP_LOG2))
    parts = write_table(d.mapInArrow(_parts(bitmap), PARTS))
    waiting = parts.where("uid IS NOT NULL")
    encoded = parts.where("uid IS NULL").groupBy("chunk_key").agg(F.first("blob").alias("blob")).mapInArrow(_encode_chunks(path), "chunk_key binary, ids binary, counts binary")
    places = waiting.select("uid", F.posexplode("keys").alias("k", "chunk_key")).join(encoded, "chunk_key")
    found = places.groupBy("uid").agg(F.collect_list(F.struct("k", "ids", "counts")).alias("found"))
    schema = "doc_id long, " + ", ".join(f"{c} {t}" for c, t, _ in columns)
    joined = waiting.select("uid", "doc_id", "blob", "starts").join(found, "uid").select("doc_id", "blob", "starts", "found").mapInArrow(_assemble(path, emit, columns), schema)
    return d.mapInArrow(_in_place(path, bitmap, emit, columns), schema).unionByName(joined)
