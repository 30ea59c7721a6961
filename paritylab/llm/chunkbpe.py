"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the last ``SPAN`` code points cuts each text into chunks that depend on the
content alone, so passages that documents share fall into the same chunks. A worker encodes a
chunk once and reuses its ids. A cut may fall inside a word: the word across the joint is encoded
anew inside a window that reaches one word further on each side, and is taken only when the
window agrees exactly with the ids that both chunks have for those outer words; otherwise the
window grows to the whole text, which is the library's own encoding.

Words are runs without blank and line feed. The vocabulary's pre-tokenizer drops white space and
its normalizers act inside a word or on white space, so words are independent of each other. A word of printable ASCII
falls into the pre-tokenizer's parts after lowering (contractions, letters, single digits, other signs), which words share.

A vocabulary without a decoder shows tokens with a blank between any two. So chunks are decoded once, too, and their
texts joined like their ids; a vocabulary with a decoder decodes whole documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from paritylab.llm.common import (code_points, gram_hashes, lean, sha256_hex, slices, spread_symbols, texts_of,
                                  worker_store)

SPAN = 48
MEAN_CHUNK = 1024
PIECE = 1 << 21
#: Bounds of what a worker remembers: words (and as many parts), and code points of chunks. A full memo starts anew.
WORDS = 220_000
CHUNK_CHARS = 4 << 20
WORD = re.compile("[^ \n]+")
#: Words that fall into PARTS once lowered; a sign that opens a special token sends the word to the library whole.
SIMPLE = re.compile(r"(?:(?!<\|)[!-~])+")
WORD_END = "</w>"
PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
BLANK = " \n"


def chunk_ends(text: str, span: int = SPAN, mean: int = MEAN_CHUNK) -> list[int]:
    """End of every chunk; each cut depends only on the ``span`` code points before it."""
    codes, ends = code_points(text), []
    for lo in range(0, max(0, len(codes) - span), PIECE):
        h = gram_hashes(spread_symbols(codes[lo:lo + PIECE + span - 1]), span)
        ends.extend((np.flatnonzero(h % np.uint64(mean) == 0) + lo + span).tolist())
    if not ends or ends[-1] != len(codes):
        ends.append(len(codes))
    return ends


class Chunk:
    """A chunk's ids (little-endian 32 bits), the token count up to each of its words, how long its first and last
    word are, its decoded text, and how much of that is the first and the last word's."""

    __slots__ = ("ids", "ends", "head", "tail", "text", "text_head", "text_tail")

    def __init__(self, ids: bytes, ends: np.ndarray, head: int, tail: int, text: str, text_head: int, text_tail: int):
        self.ids, self.ends, self.head, self.tail = ids, ends, head, tail
        self.text, self.text_head, self.text_tail = text, text_head, text_tail

    def words(self, lo: int, hi: int) -> bytes:
        return self.ids[4 * (int(self.ends[lo - 1]) if lo else 0):4 * (int(self.ends[hi - 1]) if hi else 0)]

    def decoded(self, lo: int, hi: int) -> str:
        """Text of the words from the first or second to the last or the one before."""
        if hi <= lo:
            return ""
        return self.text[self.text_head if lo else 0:len(self.text) - (self.text_tail if hi < len(self.ends) else 0)]


class ChunkEncoder:
    def __init__(self, tokenizer_file: str, span: int = SPAN, mean: int = MEAN_CHUNK):
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(tokenizer_file)
        self.lib.no_truncation()
        self.lib.no_padding()
        self.span, self.mean = span, mean
        vocabulary = self.lib.get_vocab(with_added_tokens=True)
        self.shown = [""] * (max(vocabulary.values(), default=0) + 1) if self.lib.decoder is None else None
        self.ends_word = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        for token, i in vocabulary.items():
            self.ends_word[i] = token.endswith(WORD_END)
            if self.shown:
                self.shown[i] = token + " "
        self.words: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.chunks: dict[str, Chunk] = {}
        self.held = 0

    def plain(self, text: str) -> list[int]:
        return self.lib.encode(text, add_special_tokens=False).ids

    def learn(self, chunks: list[str]) -> dict[str, Chunk]:
        """Encode the chunks that are new; returns those asked for."""
        found = {c: WORD.findall(c) for c in dict.fromkeys(chunks) if c not in self.chunks}
        wanted: set[str] = set().union(*found.values())
        fresh = list(wanted.difference(self.words))
        if len(self.words) + len(fresh) > WORDS:
            self.words.clear()
            fresh = list(wanted)
        simple = [w for w in fresh if SIMPLE.fullmatch(w)]
        cut = [PARTS.findall(w.lower()) for w in simple]
        if len(self.parts) + len(cut) > WORDS:
            self.parts.clear()
        self._encode_parts(list(set().union(*cut).difference(self.parts)))
        for w, own in zip(simple, cut):
            self.words[w] = self.parts[own[0]] if len(own) == 1 else b"".join(map(self.parts.__getitem__, own))
        self._encode([w for w in fresh if w not in self.words], self.words)
        out = {c: self.chunks[c] for c in chunks if c in self.chunks}
        for c, ws in found.items():
            ids = list(map(self.words.__getitem__, ws))
            every = b"".join(ids)
            out[c] = Chunk(every, np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids)) // 4), len(ws[0]) if ws else 0, len(ws[-1]) if ws else 0,
                           self.show(every), len(self.show(ids[0])) if ws else 0, len(self.show(ids[-1])) if ws else 0)
            self.held += len(c)
        if self.held > CHUNK_CHARS:
            self.chunks.clear()
            self.held = 0
        else:
            self.chunks.update(out)
        return out

    def _encode(self, strings: list[str], into: dict[str, bytes]) -> None:
        for lo in range(0, len(strings), 4096):
            some = strings[lo:lo + 4096]
            for w, e in zip(some, self.lib.encode_batch_fast(some, add_special_tokens=False)):
                into[w] = np.array(e.ids, "<u4").tobytes()

    def _encode_parts(self, parts: list[str]) -> None:
        """Parts are encoded many to a text, blanks between them; each ends with the only token that ends a word."""
        for lo in range(0, len(parts), 4096):
            some = [parts[i:i + 128] for i in range(lo, min(len(parts), lo + 4096), 128)]
            for own, e in zip(some, self.lib.encode_batch_fast([" ".join(own) for own in some], add_special_tokens=False)):
                ids = np.array(e.ids, "<u4")
                ends = np.flatnonzero(self.ends_word[ids]) + 1
                if len(ends) != len(own) or not len(ids) or ends[-1] != len(ids):  # a vocabulary of another kind
                    self._encode(own, self.parts)
                    continue
                packed, ends = ids.tobytes(), (4 * ends).tolist()
                self.parts.update(zip(own, map(packed.__getitem__, map(slice, [0, *ends[:-1]], ends))))

    def show(self, ids: bytes) -> str:
        """Text of tokens, a blank behind each; empty for a vocabulary with a decoder."""
        return "".join(map(self.shown.__getitem__, np.frombuffer(ids, "<u4").tolist())) if self.shown else ""

    def encode(self, texts: list[str]) -> list[tuple[bytes, str, int, int]]:
        """(ids, decoded text, chunks, joints repaired) of each text."""
        cut = []
        for t in texts:
            lo, own = 0, []
            for hi in chunk_ends(t, self.span, self.mean) if t else []:
                own.append(t[lo:hi])
                lo = hi
            cut.append(own)
        known = self.learn([c for own in cut for c in own])
        return [self.join(t, own, known) for t, own in zip(texts, cut)]

    def join(self, text: str, cut: list[str], known: dict[str, Chunk]) -> tuple[bytes, str, int, int]:
        parts: list[bytes] = []
        shown: list[str] = []
        repaired, at, pending = 0, 0, None  # pending: where the word across the joint begins
        for i, c in enumerate(cut):
            e, end = known[c], at + len(c)
            glued = i + 1 < len(cut) and c[-1] not in BLANK and cut[i + 1][0] not in BLANK
            lo, hi = 0, len(e.ends)
            if pending is not None:
                if hi == 1 and glued:
                    at = end
                    continue
                got = self.repair(text, pending, at + e.head, parts, e)
                if got is None:
                    ids = np.array(self.plain(text), "<u4").tobytes()
                    return ids, self.decode(ids), len(cut), repaired
                parts.append(got)
                shown.append(self.show(got))
                repaired += 1
                lo, pending = 1, None
            if glued:
                hi -= 1
                pending = end - e.tail
            parts.append(e.words(lo, hi))
            shown.append(e.decoded(lo, hi))
            at = end
        ids = b"".join(parts)
        return ids, "".join(shown)[:-1] if self.shown else self.decode(ids), len(cut), repaired

    def repair(self, text: str, start: int, end: int, parts: list[bytes], after: Chunk) -> bytes | None:
        """Ids of text[start:end], if a window of one more word each side agrees with what stands there."""
        lo, hi = start, end
        while lo > 0 and text[lo - 1] in BLANK:
            lo -= 1
        while lo > 0 and text[lo - 1] not in BLANK:
            lo -= 1
        if len(after.ends) > 1:
            while text[hi] in BLANK:
                hi += 1
            while hi < len(text) and text[hi] not in BLANK:
                hi += 1
            if len(after.ends) == 2:  # its last word may itself run across the next joint
                hi = end
        got = self.lib.encode(text[lo:hi], add_special_tokens=False)
        ids = np.array(got.ids, "<u4").tobytes()
        left = sum(o[0] < start - lo for o in got.offsets) if start > lo else 0
        right = sum(o[0] >= end - lo for o in got.offsets) if hi > end else 0
        before, k = b"", len(parts)
        while len(before) < 4 * left and k:
            k -= 1
            before = parts[k] + before
        if left and before[-4 * left:] != ids[:4 * left]:
            return None
        if right and after.words(1, 2) != ids[-4 * right:]:
            return None
        return ids[4 * left:len(ids) - 4 * right]

    def decode(self, ids: bytes) -> str:
        if self.shown:
            return self.show(ids)[:-1]
        return self.lib.decode(np.frombuffer(ids, "<u4").tolist(), skip_special_tokens=False)


def encode_documents(docs: DataFrame, tokenizer_file: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, n_chunks, n_repaired (and ids: binary, on request).

    Null texts are empty: no tokens, the hash of nothing. Rows are independent; an empty table gives an
    empty result. One narrow pass: chunks are shared inside a worker, because moving every chunk to one
    place costs more than encoding it (a shuffle of all text). Memory is bounded by the two memos and a slice."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_chunks", "n_repaired"] + ["ids"] * with_ids
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string, n_chunks int, n_repaired int"

    def run(batches) -> Iterator[pa.RecordBatch]:
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        store = worker_store("chunks")
        if ("chunks", tokenizer_file) not in store:
            store["chunks", tokenizer_file] = ChunkEncoder(tokenizer_file)
        coder = store["chunks", tokenizer_file]
        for b in slices(batches, text, 1 << 20):
            got = coder.encode(texts_of(b, text))
            cols = [b.column("doc_id"), pa.array([len(i) // 4 for i, _, _, _ in got], pa.int64()),
                    pa.array([sha256_hex(i) for i, _, _, _ in got], pa.string()),
                    pa.array([sha256_hex(t.encode("utf-8", "surrogatepass")) for _, t, _, _ in got], pa.string()),
                    pa.array([n for _, _, n, _ in got], pa.int32()), pa.array([r for _, _, _, r in got], pa.int32())]
            if with_ids:
                cols.append(pa.array([i for i, _, _, _ in got], pa.binary()))
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return (docs.selectExpr("cast(doc_id as bigint) AS doc_id", f"`{text}`")
            .mapInArrow(lean(run), schema + ", ids binary" * with_ids))
