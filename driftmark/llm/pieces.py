"""SentencePiece-style encoding by streaming Viterbi, and decoding back to the exact text.

The vocabulary's scores are taken as they are: the best segmentation has the largest sum of scores. A
character without a piece is spelled in byte pieces. Blanks become the vocabulary's blank mark and one is put in
front; a blank mark that stands in the text itself is spelled in bytes, so decoding gives back every text.

The search never holds a whole text. Positions within the longest piece of the current one survive; as
soon as the paths of all survivors run through one boundary, the ids up to it are committed and
forgotten. Where no piece of the vocabulary holds a blank mark behind another character, no path can
cross the start of a word: each word is a stretch of its own whose ids a bounded memory may repeat, and
the stretches of a batch that are new are searched side by side.
"""
from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .lattice import Trie, arcs, by_length

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
# What a character spelled in bytes scores below the worst piece, and the words a worker remembers.
PENALTY = 10.0
REMEMBERED = 400_000
# Texts are worked on, and rows leave a worker, in batches of about this many characters.
BATCH_CHARS = 1 << 21


class Pieces:
    """A vocabulary: scores, byte pieces and the streaming search."""

    def __init__(self, score: dict[str, float], ids: dict[str, int], byte_ids: list[int], unknown: int) -> None:
        self.score, self.ids, self.byte_ids, self.unknown = score, ids, byte_ids, unknown
        self.longest = max(map(len, score), default=1)
        self.worst = min(score.values(), default=0.0) - PENALTY
        # pieces by first character: how far to look ahead from it
        self.reach: dict[str, int] = {}
        for piece in score:
            self.reach[piece[0]] = max(self.reach.get(piece[0], 1), len(piece))
        self.by_word = not any(MARK in p.lstrip(MARK) for p in score)
        self.memory: dict[str, bytes] = {}
        # ASCII characters without a piece are one byte, so one id: they join the lattice as pieces
        spelled = [chr(b) for b in range(128) if chr(b) not in score] if byte_ids else []
        self.trie = Trie([*score, *spelled])
        self.scores = np.array([*score.values(), *[self.worst] * len(spelled)])
        self.numbers = np.array([*[ids[n] for n in score], *[byte_ids[ord(c)] for c in spelled]], np.int32)
        self.text_of = {i: p.encode() for p, i in ids.items()} | {i: bytes([b]) for b, i in enumerate(byte_ids)}

    @staticmethod
    @lru_cache(maxsize=1)
    def from_file(path: str) -> Pieces:
        """The vocabulary of a file; a worker process keeps it, and the words it remembers, from task to task."""
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        score, ids = {}, {}
        for i in range(model.get_piece_size()):
            if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = model.id_to_piece(i)
                score[piece], ids[piece] = model.get_score(i), i
        return Pieces(score, ids, [model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], model.unk_id())

    def _bytes(self, char: str) -> list[int]:
        return [self.byte_ids[b] for b in char.encode("utf-8", "surrogatepass")]

    def search(self, text: str, literal: frozenset[int] = frozenset()) -> Iterator[int]:
        """Ids of the best segmentation of ``text``; positions in ``literal`` are spelled in bytes.

        Ties go to the segmentation whose last piece is longest. Scores of the paths start anew at each
        commit, so only the survivors' differences are ever added up.
        """
        score, reach, longest = self.score, self.reach, self.longest
        size = len(text)
        # best[i % n], back[i]: score and start of the last piece of the best path to boundary i
        window: dict[int, float] = {0: 0.0}
        back: dict[int, int] = {}
        done = 0
        for at in range(size):
            base = window.pop(at, None)
            if base is None:
                continue
            char = text[at]
            far = min(size, at + reach.get(char, 1))
            single = None if at in literal else score.get(char)
            value = base + (self.worst if single is None else single)
            if value > window.get(at + 1, -np.inf):
                window[at + 1], back[at + 1] = value, at
            if at not in literal:
                for end in range(at + 2, far + 1):
                    if end - 1 in literal:
                        break
                    found = score.get(text[at:end])
                    if found is not None and base + found > window.get(end, -np.inf):
                        window[end], back[end] = base + found, at
            if at - done >= 4 * longest or len(window) == 1:
                boundary = self._meet(window, back, done)
                if boundary > done:
                    yield from self._commit(text, literal, back, done, boundary)
                    low = max(window.values())
                    window = {i: v - low for i, v in window.items()}
                    done = boundary
        if done < size:
            yield from self._commit(text, literal, back, done, size)

    @staticmethod
    def _meet(window: dict[int, float], back: dict[int, int], done: int) -> int:
        """The last boundary that the paths of all survivors share."""
        live = set(window)
        while len(live) > 1:
            last = max(live)
            if last <= done:
                return done
            live.remove(last)
            live.add(back[last])
        return max(live.pop(), done)

    def _commit(self, text: str, literal: frozenset[int], back: dict[int, int], done: int, boundary: int) -> list[int]:
        cuts, at = [boundary], boundary
        while at > done:
            at = back[at]
            cuts.append(at)
        for i in [i for i in back if i <= boundary]:
            del back[i]
        out = []
        for a, b in zip(cuts[::-1], cuts[-2::-1]):
            piece = text[a:b]
            if b - a == 1 and (a in literal or piece not in self.ids):
                out += self._bytes(piece)
            else:
                out.append(self.ids[piece])
        return out

    def _stretches(self, words: list[str]) -> None:
        """Put the ids of ``words`` (each with its blanks in front) into the memory, as 32-bit integers."""
        for rows, codes in by_length(words):
            size = codes.shape[1]
            if size > 4 * self.longest:
                for i in rows.tolist():
                    self.memory[words[i]] = np.fromiter(self.search(words[i]), np.int32).tobytes()
                continue
            best = np.full((len(rows), size + 1), -np.inf)
            best[:, 0] = 0.0
            cut = np.zeros((len(rows), size + 1), np.int64)
            last = np.full((len(rows), size + 1), -1, np.int64)
            odd = np.zeros(len(rows), bool)
            for start, length, row, piece in arcs(codes, self.trie):
                value = best[row, start] + np.where(piece < 0, self.worst, self.scores[piece])
                better = value > best[row, start + length]
                row, piece = row[better], piece[better]
                best[row, start + length] = value[better]
                cut[row, start + length], last[row, start + length] = start, piece
            # walk the paths of all words back together
            at, found = np.full(len(rows), size), []
            alive = np.arange(len(rows))
            while len(alive):
                piece = last[alive, at[alive]]
                odd[alive[piece < 0]] = True
                step = np.full(len(rows), -1, np.int32)
                step[alive] = np.where(piece < 0, -1, self.numbers[piece])
                found.append(step)
                at[alive] = cut[alive, at[alive]]
                alive = alive[at[alive] > 0]
            table = np.stack(found[::-1], axis=1)
            counts = (table >= 0).sum(axis=1)
            raw = table[table >= 0].astype(np.int32).tobytes()
            ends = (np.cumsum(counts) * 4).tolist()
            for i, a, b, spelled in zip(rows.tolist(), [0, *ends], ends, odd.tolist()):
                # characters spelled in bytes are rare: such words are searched one by one
                self.memory[words[i]] = np.fromiter(self.search(words[i]), np.int32).tobytes() if spelled else raw[a:b]

    @staticmethod
    def _cut(text: str) -> list[str]:
        """The words of ``text``, each with the blanks in front of it as marks."""
        words = text.split(" ")
        if "" not in words:
            return [MARK + w for w in words]
        out, blanks = [], 0
        for word in words:
            blanks += 1
            if word:
                out.append(MARK * blanks + word)
                blanks = 0
        return [*out, MARK * blanks] if blanks else out

    def encode_many(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text as 32-bit integers; the empty text has none."""
        cut: list[list[str] | None] = [self._cut(t) if t and self.by_word and MARK not in t else None for t in texts]
        wanted = set().union(*[c for c in cut if c])
        if len(self.memory) > REMEMBERED:
            self.memory.clear()
        self._stretches([w for w in wanted if w not in self.memory])
        memory, out = self.memory, []
        for text, words in zip(texts, cut):
            if words is not None:
                out.append(np.frombuffer(b"".join([memory[w] for w in words]), np.int32))
            elif text:
                literal = frozenset(i + 1 for i, c in enumerate(text) if c == MARK)
                out.append(np.fromiter(self.search(MARK + text.replace(" ", MARK), literal), np.int32))
            else:
                out.append(np.zeros(0, np.int32))
        return out

    def encode(self, text: str) -> np.ndarray:
        return self.encode_many([text])[0]

    def decode(self, ids: np.ndarray) -> str:
        """The text that :meth:`encode` made ``ids`` of."""
        table = _table(self)
        return b"".join([table[i] for i in ids.tolist()])[1:].decode("utf-8", "surrogatepass")


def _table(pieces: Pieces) -> list[bytes]:
    """Decoded bytes by id, for decoding without a test per id."""
    mark, byte = MARK.encode(), set(pieces.byte_ids)
    out = [b""] * (max(pieces.text_of) + 1)
    for i, t in pieces.text_of.items():
        out[i] = t if i in byte else t.replace(mark, b" ")
    return out


def encode(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """(id, n_tokens, ids) for every row of ``documents``; ``ids`` is an array of int.

    Null and empty texts have no ids. Repeated rows and null ids keep their rows, other columns are not
    read, an empty table gives no rows. Texts are encoded whole; the search's memory does not grow with them.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = Pieces.from_file(vocabulary)
        for batch in batches:
            texts, first, size = batch.column(1), 0, 0
            held: list[str] = []
            for row in range(batch.num_rows):
                held.append(texts[row].as_py() or "")
                size += len(held[-1])
                if size >= BATCH_CHARS or row + 1 == batch.num_rows:
                    yield pack(batch, first, pieces.encode_many(held))
                    held, size, first = [], 0, row + 1

    def pack(batch: pa.RecordBatch, first: int, held: list[np.ndarray]) -> pa.RecordBatch:
        sizes = np.array([len(h) for h in held])
        offsets = pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32))
        ids = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(held)))
        return pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(held)), pa.array(sizes), ids], ["id", "n_tokens", "ids"])

    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["id"].dataType.simpleString()
    return source.mapInArrow(run, f"id {kind}, n_tokens bigint, ids array<int>").withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, ids_col: str = "ids", text_col: str = "text", vocabulary: str = VOCABULARY) -> DataFrame:
    """``encoded`` with the exact text each array of ids was made of. Null and empty arrays give the empty text."""
    schema = T.StructType([*encoded.schema.fields, T.StructField(text_col, T.StringType())])
    at = encoded.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table(Pieces.from_file(vocabulary))
        for batch in batches:
            first, held, count = 0, [], 0
            for row, ids in enumerate(batch.column(at)):
                held.append(b"".join([table[i] for i in ids.values.to_pylist()])[1:] if ids.is_valid else b"")
                count += len(held[-1])
                if count >= BATCH_CHARS or row + 1 == batch.num_rows:
                    texts = pa.array(held, pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([*batch.slice(first, len(held)).columns, texts], schema.names)
                    first, held, count = row + 1, [], 0

    return encoded.mapInArrow(run, schema)
