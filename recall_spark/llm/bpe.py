"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over the last 16 bytes cuts each text into chunks, so equal passages are cut alike wherever they
stand. A chunk that a task has seen before, in any document, is not encoded again. Cuts fall anywhere, so the
word that a cut goes through (from the white space before it to the one after it, over as many chunks as it
takes) is encoded anew as a whole; tokens never cross white space, which makes the repaired join agree with
the encoding of the whole text.

Null is the empty text. What a task remembers is bounded (`CHUNKS`, `WORDS` entries); forgetting costs time only.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table, texts_of

CHUNK_BITS, CHUNKS, WORDS = 9, 20_000, 600_000
#: Words of these letters, with at most a run of these marks behind, are one or two pre-tokens whatever surrounds them.
_PLAIN = re.compile("([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?#*$%&]*)")


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cuts_of(text: bytes, bits: int = CHUNK_BITS) -> list[int]:
    """Where chunks begin, and the end: places whose rolling hash over the 16 bytes before ends in `bits` zeros, at a character's start."""
    if len(text) < 32:
        return [0, len(text)]
    raw = np.frombuffer(text, np.uint8)
    h = raw.astype(np.uint32) * np.uint32(2654435761)
    h ^= h >> np.uint32(15)
    factor = 0x01000193
    for step in (1, 2, 4, 8):
        shifted = h[:-step] * np.uint32(pow(factor, step, 1 << 32))
        h = h.copy()
        h[step:] += shifted
    here = np.flatnonzero((h[15:-1] >> np.uint32(32 - bits)) == 0) + 16
    here = here[(raw[here] & 0xC0) != 0x80]
    return [0, *here.tolist(), len(text)]


class Encoder:
    """ids of whole texts, as bytes of little-endian unsigned 16-bit integers (32 for larger vocabularies).

    For vocabularies that lower-case, split at white space and end words by `</w>`.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        size = max(self.tok.get_vocab(with_added_tokens=True).values()) + 1
        self.kind = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        self.token = [self.tok.id_to_token(i) or "" for i in range(size)]
        self.ends = np.array([t.endswith("</w>") for t in self.token])
        self.chunks: dict[bytes, tuple[bytes, bytes | None, bytes]] = {}
        self.words: dict[bytes, bytes] = {}
        self.letters: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def _plain(self, text: str) -> np.ndarray:
        return np.array(self.tok.encode(text, add_special_tokens=False).ids, self.kind)

    def learn(self, words: set[bytes]) -> None:
        """Encodes words that aren't known. Letters-only words go together in one text: each ends where a token ends a word."""
        if len(self.words) > WORDS:
            self.words.clear()
            self.letters.clear()
        plain = []
        for word in words.difference(self.words):
            text = word.decode("utf-8", "replace")
            if m := _PLAIN.fullmatch(text):
                plain.append((word, m[1].lower(), m[2]))
            else:
                self.words[word] = self._plain(text).tobytes()
        new = list({x for _, x, _ in plain}.difference(self.letters))
        for start in range(0, len(new), 4096):
            part = new[start : start + 4096]
            ids = self._plain(" ".join(part))
            stops = (np.flatnonzero(self.ends[ids]) + 1).tolist()
            if len(stops) != len(part):  # not a vocabulary with word ends: one by one
                self.letters.update((x, self._plain(x).tobytes()) for x in part)
            else:
                raw, size = ids.tobytes(), self.kind.itemsize
                self.letters.update((x, raw[a * size : b * size]) for x, a, b in zip(part, [0, *stops], stops, strict=False))
        for mark in {x for _, _, x in plain}.difference(self.marks):
            self.marks[mark] = self._plain(mark).tobytes()
        self.words.update((word, self.letters[x] + self.marks[mark] if mark else self.letters[x]) for word, x, mark in plain)
        if len(self.marks) > CHUNKS:
            self.marks = {"": b""}

    def encode(self, texts: list[bytes]) -> list[bytes]:
        if len(self.chunks) > CHUNKS:
            self.chunks.clear()
        laid, fresh = [], {}
        for text in texts:
            cuts = cuts_of(text)
            own = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
            laid.append(own)
            for c in own:
                if c not in self.chunks and c not in fresh:
                    fresh[c] = self._parts(c)
        need: set[bytes] = set()
        for _, middle, _ in fresh.values():
            need.update(middle or ())
        plans = []
        for own in laid:
            plan, held = [], b""
            for c in own:
                if c in fresh:
                    head, middle, tail = fresh[c]
                else:
                    head, middle, tail = self.chunks[c]
                if middle is None:  # no white space: the word goes on
                    held += head
                    continue
                plan.append(held + head)
                plan.append(c)
                need.add(held + head)
                held = tail
            plan.append(held)
            need.add(held)
            plans.append(plan)
        need.discard(b"")
        self.learn(need)
        words = self.words
        words[b""] = b""
        for c, (head, middle, tail) in fresh.items():
            self.chunks[c] = (head, None if middle is None else b"".join([words[w] for w in middle]), tail)
        chunks = self.chunks
        return [b"".join([chunks[x][1] if i % 2 else words[x] for i, x in enumerate(plan)]) for plan in plans]

    @staticmethod
    def _parts(chunk: bytes):
        """What precedes the first white space, the whole words, what follows the last white space."""
        words = chunk.split()
        if len(words) == 1 and len(words[0]) == len(chunk):
            return chunk, None, b""
        head = words.pop(0) if words and not _space(chunk[0]) else b""
        tail = words.pop() if words and not _space(chunk[-1]) else b""
        return head, words, tail

    def decode(self, ids: bytes) -> str:
        """As the library does for a vocabulary without a decoder: tokens joined by blanks."""
        token = self.token
        return " ".join([token[i] for i in np.frombuffer(ids, self.kind).tolist()])


def _space(b: int) -> bool:
    return b == 32 or 9 <= b <= 13


def encoded(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): ids as unsigned 32-bit integers, digests in lower-case hex."""
    path = path or vocabulary("word_bpe_49k.json")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in slices(batches):
            enc = enc or Encoder(path)
            ids = enc.encode(texts_of(batch))
            size = enc.kind.itemsize
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(x) // size for x in ids], pa.int64()),
                    pa.array([hashlib.sha256(np.frombuffer(x, enc.kind).astype("<u4").tobytes()).hexdigest() for x in ids], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(x).encode()).hexdigest() for x in ids], pa.string()),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(table(spark, sf_dir, "documents"))


QUERIES = {"op8_bpe": op8_bpe}
ORACLES: dict[str, str] = {}
