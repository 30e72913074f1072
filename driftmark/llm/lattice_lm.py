"""Language-model scores from a subword lattice and the corpus's word counts.

A text is its words (A-Z lower-cased) and one end token. A word's lattice has an arc for every piece of
an existing vocabulary that fits somewhere, and one arc over the whole word if training documents hold
it. A log-space forward recursion adds up all segmentations into pieces to q(word), which sums to at
most one over all words. The whole-word arc has weight c / N, with a share for words never seen left to
the subwords:

    P(word) = (c + PRIOR * q(word)) / (N + PRIOR),  PRIOR = ``PRIOR_SHARE`` * V.

The vocabulary's scores rank its pieces. A piece of rank *r* starts with weight 1 / (r + ``RANK_SHIFT``),
normalised over the pieces that may begin a word and over those that may go on. Forward-backward
expectations over the distinct training words then adapt the weights, ``ROUNDS`` times: each round is one
pass over the written words, whose expectations are added over all of them, so the result does not depend
on how the words are dealt out. New words resemble rare words, so every distinct word counts once. Only
one number per piece reaches the driver.

c, N and V are counts over all training documents. Every distinct word of a block of documents travels
once to the part that owns it, is counted there, run through its lattice once, and the answer travels
back (see :mod:`blocks`); what is gathered grows with the corpus.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import blocked, part_cuts
from .lattice import Trie, arcs, by_length
from .storage import written
from .words import Words, slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
RANK_SHIFT = 10.0
ROUNDS = 3
# Weight of the vocabulary's ranks beside the expected uses of pieces.
PRIOR_USES = 100.0
PRIOR_SHARE = 1.0
BLOCK_BYTES = 8 << 20
# Text whose distinct words are found at a time, and distinct words of one row of theirs.
TRAIN_BYTES, WORDS_BYTES = 8 << 20, 1 << 20
HELD_OUT = (7, 2)
_LN10 = np.log(10.0)


class SubwordLattice:
    """Natural-log probability of words, summed over all segmentations into pieces."""

    def __init__(self, pieces: dict[str, float]) -> None:
        """``pieces``: scores as the vocabulary has them; only their order counts. A character without a piece goes
        on in bytes, each with an equal share of one more class of pieces."""
        names = [p for p in pieces if MARK not in p.lstrip(MARK) and not p.startswith(MARK * 2)]
        order = sorted(names, key=lambda p: -pieces[p])
        # the last entry stands for the 256 bytes together
        self.begins = np.array([*[p.startswith(MARK) for p in order], False])
        self.weight = 1.0 / (np.arange(len(order) + 1) + RANK_SHIFT)
        self.trie = Trie(order)
        self.adapt(np.zeros(len(order) + 1), 0.0)

    @classmethod
    def from_file(cls, path: str) -> SubwordLattice:
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return cls({model.id_to_piece(i): model.get_score(i) for i in range(model.get_piece_size())
                    if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))})

    def adapt(self, expected: np.ndarray, words: float) -> None:
        """Weights from the expected uses of each piece in ``words`` words, with the vocabulary's ranks as a prior."""
        cost = np.zeros(len(self.weight))
        for side in (self.begins, ~self.begins):
            rank = self.weight[side] / self.weight[side].sum()
            cost[side] = np.log((expected[side] + PRIOR_USES * rank) / (expected[side].sum() + PRIOR_USES))
        self.cost, self.byte = cost[:-1], float(cost[-1] - np.log(256.0))
        stop = (words + 1.0) / (expected.sum() + 2.0)
        self.stop, self.go_on = float(np.log(stop)), float(np.log1p(-min(stop, 1 - 1e-9)))

    def _weights(self, arc: tuple, codes: np.ndarray) -> np.ndarray:
        start, length, row, piece = arc
        n_bytes = np.ones(len(row)) if length > 1 else _utf8(codes[row, start])
        spelled = n_bytes * self.byte + (n_bytes - 1) * self.go_on
        # every piece but the first comes after a decision to go on
        return np.where(piece < 0, spelled, self.cost[piece]) + (self.go_on if start else 0.0)

    def _forward(self, codes: np.ndarray, lattice: Iterable[tuple]) -> np.ndarray:
        alpha = np.full((len(codes), codes.shape[1] + 1), -np.inf)
        alpha[:, 0] = 0.0
        for arc in lattice:
            start, length, row, _ = arc
            alpha[row, start + length] = np.logaddexp(alpha[row, start + length], alpha[row, start] + self._weights(arc, codes))
        return alpha

    def log_probability(self, words: list[str]) -> np.ndarray:
        """Forward recursion over the boundaries of every word, words of one length side by side."""
        out = np.full(len(words), -np.inf)
        for rows, codes in by_length([MARK + w for w in words]):
            out[rows] = self._forward(codes, arcs(codes, self.trie))[:, -1] + self.stop
        return out

    def expected(self, words: list[str]) -> np.ndarray:
        """Expected uses of each piece over ``words`` under the present weights."""
        uses = np.zeros(len(self.weight))
        for _, codes in by_length([MARK + w for w in words]):
            lattice = list(arcs(codes, self.trie))
            alpha = self._forward(codes, lattice)
            beta = np.full(alpha.shape, -np.inf)
            beta[:, -1] = 0.0
            for arc in reversed(lattice):
                start, length, row, piece = arc
                weight = self._weights(arc, codes) + beta[row, start + length]
                beta[row, start] = np.logaddexp(beta[row, start], weight)
                share = np.exp(alpha[row, start] + weight - alpha[row, -1])
                uses += np.bincount(np.where(piece < 0, len(uses) - 1, piece), weights=share, minlength=len(uses))
        return uses


def _utf8(code: np.ndarray) -> np.ndarray:
    return 1.0 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)


_QUESTION = "part bigint, block bigint, size bigint, words binary, counts binary"
_ANSWER = "block bigint, part bigint, size bigint, counts binary, subword binary"
_WORDS = pa.schema([("part", pa.int64()), ("words", pa.binary()), ("distinct", pa.int64()), ("tokens", pa.int64())])
_QUESTION_SCHEMA = pa.schema([("part", pa.int64()), ("block", pa.int64()), ("size", pa.int64()), ("words", pa.binary()), ("counts", pa.binary())])


class _Tokens:
    """The words of a block: places of the distinct ones in hash order, and per word its document row."""

    def __init__(self, table: pa.Table | pa.RecordBatch) -> None:
        values, rows, self.text = [], [], []
        where: list[np.ndarray] = []
        self.counts = np.zeros(table.num_rows, np.int64)
        for first, last, data, offsets in slices(table.column("text")):
            words = Words(data, offsets, lower=True)
            self.counts[first:last] = words.counts
            values.append(words.hashes())
            rows.append(words.doc + first)
            where.append(np.stack([np.full(len(words.start), len(self.text)), words.start, words.end]))
            self.text.append(words.data.tobytes())
        value = np.concatenate(values) if values else np.zeros(0, np.uint64)
        self.row = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        self.keys, self.first, self.which = np.unique(value, return_index=True, return_inverse=True)
        self.where = np.concatenate(where, axis=1) if where else np.zeros((3, 0), np.int64)

    def words(self) -> list[bytes]:
        return [self.text[t][a:b] for t, a, b in self.where[:, self.first].T.tolist()]


def scores(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
           held_out: tuple[int, int] = HELD_OUT, prior_share: float = PRIOR_SHARE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of ``documents``.

    Documents whose crc32 of the id as text has the remainder ``held_out[1]`` modulo ``held_out[0]`` are
    not learned from. Scores are log10 probabilities; ``base_score`` is the add-one word unigram. A null
    or empty text is its end token alone; a null id counts as empty text and is learned from. Repeated
    rows count, and are scored, as often as they occur. Without training documents all counts are 0.
    Other columns are not read, an empty table gives no rows.
    """
    docs, parts = blocked(documents, id_col, text_col, block_bytes)
    modulus, remainder = held_out
    crc = F.crc32(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary"))
    docs = docs.withColumn("held_out", crc % modulus == remainder)

    def ask(table: pa.Table) -> pa.Table:
        tokens = _Tokens(table)
        train = ~table.column("held_out").to_numpy(zero_copy_only=False)
        counts = np.bincount(tokens.which[train[tokens.row]], minlength=len(tokens.keys))
        words, cuts = tokens.words(), part_cuts(tokens.keys, parts)
        block, rows = table.column("block")[0].as_py(), []
        for part in range(parts):
            a, b = int(cuts[part]), int(cuts[part + 1])
            mine, own = words[a:b], counts[a:b]
            if a == b:
                continue
            rows.append({"part": part, "block": block, "size": len(mine), "words": b"\n".join(mine), "counts": own.astype(np.int64).tobytes()})
        return pa.Table.from_pylist(rows, _QUESTION_SCHEMA)

    def train_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # cut by bytes, as an Arrow batch holds texts of any length
            for first, last, *_ in slices(batch.column(0), TRAIN_BYTES):
                tokens = _Tokens(batch.slice(first, last - first))
                words, cuts, each = tokens.words(), part_cuts(tokens.keys, parts), np.bincount(tokens.which, minlength=len(tokens.keys))
                del tokens
                rows = [{"part": part, "words": b"\n".join(words[cuts[part]:cuts[part + 1]]), "distinct": int(cuts[part + 1] - cuts[part]),
                         "tokens": int(each[cuts[part]:cuts[part + 1]].sum())} for part in range(parts) if cuts[part] < cuts[part + 1]]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _WORDS)

    def distinct(table: pa.Table) -> pa.Table:
        words = sorted(set().union(*[blob.as_py().split(b"\n") for blob in table.column("words")]))
        size, every = max(1, WORDS_BYTES // 16), sum(table.column("tokens").to_pylist())
        cut = [words[k:k + size] for k in range(0, len(words), size)]
        return pa.Table.from_pylist([{"part": table.column("part")[0].as_py(), "words": b"\n".join(c), "distinct": len(c), "tokens": 0 if k else every}
                                     for k, c in enumerate(cut)], _WORDS)

    kinds = "part bigint, words binary, distinct bigint, tokens bigint"
    train = docs.filter("not held_out")
    vocabulary_words = written(train.select("text").mapInArrow(train_words, kinds).groupBy("part").applyInArrow(distinct, kinds))
    ends = train.count()
    n_words, n_distinct = (x or 0 for x in vocabulary_words.agg(F.sum("tokens"), F.sum("distinct")).first())
    total, distinct_tokens = n_words + ends, n_distinct + (ends > 0)
    uses = np.zeros(0)
    for _ in range(ROUNDS):
        def expect(batches: Iterator[pa.RecordBatch], uses: np.ndarray = uses) -> Iterator[pa.RecordBatch]:
            lattice, total = SubwordLattice.from_file(vocabulary), None
            if len(uses):
                lattice.adapt(uses[1:], uses[0])
            for batch in batches:
                for blob in batch.column(1):
                    words = [w.decode("utf-8", "replace") for w in blob.as_py().split(b"\n")]
                    # one more number for the words themselves
                    found = np.r_[float(len(words)), lattice.expected(words)]
                    total = found if total is None else total + found
            if total is not None:
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, len(total) - 1)), pa.array(total)], ["piece", "uses"])

        # one number per piece of the vocabulary
        learned = vocabulary_words.mapInArrow(expect, "piece bigint, uses double").groupBy("piece").agg(F.sum("uses")).collect()
        uses = np.array([u for _, u in sorted(learned)])

    def answer(table: pa.Table) -> pa.Table:
        lattice = SubwordLattice.from_file(vocabulary)
        if len(uses):
            lattice.adapt(uses[1:], uses[0])
        place: dict[bytes, int] = {}
        which = []
        for blob, size in zip(table.column("words").to_pylist(), table.column("size").to_pylist()):
            if size:
                which.append(np.fromiter((place.setdefault(w, len(place)) for w in blob.split(b"\n")), np.int64, size))
        every = np.concatenate(which) if which else np.zeros(0, np.int64)
        counts = np.frombuffer(b"".join(table.column("counts").to_pylist()), np.int64)
        held = np.bincount(every, weights=counts, minlength=len(place)).astype(np.int64)
        subword = lattice.log_probability([w.decode("utf-8", "replace") for w in place])
        sizes = table.column("size").to_numpy()
        ends, out = np.cumsum(sizes), []
        for block, size, end in zip(table.column("block").to_pylist(), sizes.tolist(), ends.tolist()):
            mine = every[end - size:end]
            out.append({"block": block, "part": table.column("part")[0].as_py(), "size": size, "counts": held[mine].tobytes(),
                        "subword": subword[mine].tobytes()})
        return pa.Table.from_pylist(out, pa.schema([("block", pa.int64()), ("part", pa.int64()), ("size", pa.int64()), ("counts", pa.binary()), ("subword", pa.binary())]))

    def score(table: pa.Table, answers: pa.Table) -> pa.Table:
        names = ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not len(table):
            kinds = [table.schema.field("id").type, pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
            return pa.table([pa.array([], k) for k in kinds], names)
        tokens, answers = _Tokens(table), answers.sort_by("part")
        count = np.frombuffer(b"".join(answers.column("counts").to_pylist()), np.int64)
        subword = np.frombuffer(b"".join(answers.column("subword").to_pylist()), np.float64)
        base = np.log10((count + 1) / (total + distinct_tokens + 1))
        # q is spread over words and the end token as training documents are long; it never counts as unseen
        end_share = ends / total if total else 0.5
        prior = max(prior_share * distinct_tokens, 1.0)
        known = np.log(np.maximum(count, 1)) + np.where(count > 0, 0.0, -np.inf)
        model = (np.logaddexp(known, np.log(prior * (1 - end_share)) + subword) - np.log(total + prior)) / _LN10
        end_model = np.log10((ends + prior * end_share) / (total + prior))
        docs_n = len(table)
        sums = [np.bincount(tokens.row, weights=v[tokens.which], minlength=docs_n) for v in (base, model, count > 0)]
        return pa.table([
            table.column("id"), table.column("held_out"), pa.array(tokens.counts + 1), pa.array(sums[2].astype(np.int64) + (ends > 0)),
            pa.array(np.full(docs_n, total)), pa.array(sums[0] + np.log10((ends + 1) / (total + distinct_tokens + 1))), pa.array(sums[1] + end_model)], names)

    answers = docs.groupBy("block").applyInArrow(ask, _QUESTION).groupBy("part").applyInArrow(answer, _ANSWER)
    kind = docs.schema["id"].dataType.simpleString()
    out = f"id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"
    return docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(score, out).withColumnRenamed("id", id_col)
