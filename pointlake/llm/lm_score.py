"""Subword lattice likelihood.

A document is words, each opened by a word mark, then an end. Every way to spell a word with pieces
of an existing subword vocabulary is a path through a lattice; a unigram distribution over pieces
weights the paths, and a forward recursion in log space sums them. A word of the training documents
is a piece of its own besides, from the mark to its end: DISCOUNT is taken off its count, and what
that frees is the weight of the paths through the vocabulary's pieces. So the model grows with the
corpus. The score is the log10 of the marginal probability of the document.

The vocabulary's own scores are used when it is a unigram model. A BPE vocabulary's scores are
merge ranks, not log probabilities; then the weights are the smoothed relative frequencies of the
vocabulary's own segmentation over all training documents.

Every distinct word's probability is computed once. Words aggregate map-side, the ``hot`` most
frequent (a fixed number) are sent to every task, and only the rest meet their entries in a join,
whose keys therefore have no hot values.

Edge cases: a null text is empty: its only token is the end. Ids are of an integer type; a null id
counts as the text "" and is in the training part. Repeated rows are scored each. A very long text is
read whole, and a very long word costs in proportion to its length. A corpus without training
documents has N = 0 and V = 0 and is scored by the vocabulary's pieces alone. Columns of the input
other than id and text, whatever their names, are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import compress, repeat
from math import log10

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucket, materialise, numbered

MARK = "▁".encode()
#: Counter entries at which a task hands on what it has counted.
FLUSH = 400_000
#: Words that are sent to every task.
HOT = 200_000
#: Taken off the count of each word and of the end.
DISCOUNT = 0.75
#: Stands for the end in the table of words: no word holds a space.
END = b" "


def held_out(ident: Column, parts: int = 7, part: int = 2) -> Column:
    return F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")) % parts == part


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _texts(batch: pa.RecordBatch, name: str) -> Iterable[bytes | None]:
    return (x.as_py() for x in batch.column(name).cast(pa.binary()))


def count_words(docs: DataFrame) -> DataFrame:
    """(lm_text, lm_held) -> word, n (in training documents), m (in all), END among them."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = {False: Counter(), True: Counter()}
        for b in it:
            for text, held in zip(_texts(b, "lm_text"), b.column("lm_held").to_pylist()):
                seen[held].update(words_of(text))
                seen[held][END] += 1
                if len(seen[held]) > FLUSH:
                    yield from _flush(seen)
        yield from _flush(seen)

    return docs.mapInArrow(counted, "word binary, n long, m long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("m").alias("m"))


def _flush(seen: dict[bool, Counter]) -> Iterator[pa.RecordBatch]:
    for held, c in seen.items():
        n = pa.array(list(c.values()), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(np.zeros(len(c), np.int64)) if held else n, n], names=["word", "n", "m"])
        c.clear()


class Lattice:
    """Piece weights (log10) by spelling, over bytes; the word mark is a space."""

    def __init__(self, weights: dict[bytes, float]):
        self.weights = weights
        self.heads = {p[:k] for p in weights for k in range(1, len(p) + 1)}

    def log10(self, word: bytes) -> float:
        """Forward recursion: alpha[i] is the log probability of all spellings of the first i bytes."""
        text, weights, heads = b" " + word, self.weights, self.heads
        n = len(text)
        at: list = [None] * (n + 1)
        at[0] = (0.0,)
        total = 0.0
        for i in range(n):
            into = at[i]
            if into is None:
                continue
            at[i] = None
            if len(into) == 1:
                total = into[0]
            else:
                most = max(into)
                total = most + log10(sum([10.0 ** (x - most) for x in into]))
            for j in range(i + 1, n + 1):
                piece = text[i:j]
                if piece in weights:
                    if at[j] is None:
                        at[j] = [total + weights[piece]]
                    else:
                        at[j].append(total + weights[piece])
                elif piece not in heads:
                    break
        most = max(at[n])
        return most + log10(sum([10.0 ** (x - most) for x in at[n]]))


def vocabulary(path: str) -> tuple[list[bytes | None], bool]:
    """The spelling of each piece id (None: not in the lattice), and whether its scores are log probabilities."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    spelt: list[bytes | None] = []
    for k in range(sp.get_piece_size()):
        piece = sp.id_to_piece(k)
        if sp.is_byte(k):
            spelt.append(bytes([int(piece[3:5], 16)]))
        elif sp.is_control(k) or sp.is_unknown(k) or sp.is_unused(k):
            spelt.append(None)
        else:
            b = piece.encode()
            b = b" " + b[len(MARK) :] if b.startswith(MARK) else b
            spelt.append(None if MARK in b or b.lower() != b else b)
    scores = [sp.get_score(k) for k in range(len(spelt)) if spelt[k] is not None and not sp.is_byte(k)]
    ranked = all(s == int(s) for s in scores)
    return spelt, not ranked


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """How often the vocabulary's own segmentation of all training words uses each piece."""

    def counted(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        total = np.zeros(sp.get_piece_size(), dtype=np.int64)
        for b in it:
            w = [x.decode("utf-8", "replace") for x in b.column("word").to_pylist()]
            n = b.column("n").to_pylist()
            for ids, times in zip(sp.encode(w, num_threads=1), n):
                for k in ids:
                    total[k] += times
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int64)), pa.array(total[used])], names=["piece", "n"])

    return words.where("n > 0").mapInArrow(counted, "piece long, n long").groupBy("piece").agg(F.sum("n").alias("n"))


def learn(words: DataFrame, path: str) -> Lattice:
    """The lattice. What is collected has one row for each piece."""
    spelt, scored = vocabulary(path)
    mass: dict[bytes, float] = {}
    if scored:
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        for k, b in enumerate(spelt):
            if b is not None:
                mass[b] = mass.get(b, 0.0) + float(np.exp(sp.get_score(k)))
        least = min(mass.values())
        for byte in range(256):  # every text has a spelling
            mass.setdefault(bytes([byte]), least)
        return Lattice({b: log10(m) for b, m in mass.items()})
    counts = {r["piece"]: r["n"] for r in piece_counts(words, path).collect()}
    for k, b in enumerate(spelt):
        if b is not None:
            mass[b] = mass.get(b, 0.0) + counts.get(k, 0) + 1.0
    for byte in range(256):
        mass.setdefault(bytes([byte]), 1.0)
    whole = sum(mass.values())
    return Lattice({b: log10(m / whole) for b, m in mass.items()})


class Model:
    """Word probabilities: the lattice's, and the arc of the whole word where the corpus has it."""

    def __init__(self, lattice: Lattice, tokens: int, distinct: int):
        self.lattice, self.tokens = lattice, tokens
        #: The share of all counts that the discount frees.
        self.freed = log10(DISCOUNT * distinct / tokens) if tokens else 0.0

    def log10(self, word: bytes, n: int) -> float:
        pieces = self.freed + self.lattice.log10(word)
        if not n:
            return pieces
        whole = log10((n - DISCOUNT) / self.tokens)
        most = max(whole, pieces)
        return most + log10(10.0 ** (whole - most) + 10.0 ** (pieces - most))

    def end(self, n: int) -> float:
        """An end that was never seen has the freed share to itself."""
        return log10((n - DISCOUNT) / self.tokens) if n else self.freed


def word_scores(words: DataFrame, model: Model) -> DataFrame:
    """(word, n, m) -> word, known, base (log10 of n + 1), lm (log10 of the marginal), m. Each word once."""
    shared = words.sparkSession.sparkContext.broadcast((model.lattice.weights, model.tokens, model.freed))

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, tokens, freed = shared.value
        own = Model(Lattice(weights), tokens, 1)
        own.freed = freed
        for b in it:
            n = b.column("n").to_numpy()
            lm = [own.log10(w, k) for w, k in zip(b.column("word").to_pylist(), n.tolist())]
            yield pa.RecordBatch.from_arrays([b.column("word"), pa.array(n > 0), pa.array(np.log10(n + 1.0)), pa.array(lm, pa.float64()), b.column("m")], names=["word", "known", "base", "lm", "m"])

    return words.mapInArrow(scored, "word binary, known boolean, base double, lm double, m long")


def most_frequent(words: DataFrame, most: int) -> int:
    """A count that at most ``most`` words reach. From a histogram of the counts by their leading
    digits, a few thousand rows at any size; no task sorts the words of all others."""
    held, cut = 0, 1 << 62
    for r in words.groupBy(bucket(F.col("m")).alias("m")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("m")).collect():
        held += r["n"]
        if held > most:
            break
        cut = r["m"]
    return cut


def lm_score(docs: DataFrame, vocab: str, id_col: str = "doc_id", text_col: str = "text", parts: int = 7, part: int = 2, hot: int = HOT) -> DataFrame:
    """One row for each document: the id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    rows, at_ = numbered(docs, "lm_in_")
    ident = F.col(at_(id_col))
    slim = rows.select(ident.alias("lm_id"), F.coalesce(at_(text_col), F.lit("")).alias("lm_text"), held_out(ident, parts, part).alias("lm_held"))
    counted = materialise(count_words(slim), "lm-words")
    is_end = F.col("word") == F.lit(END)
    sums = counted.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(k) for k, c in (("n", F.col("n")), ("v", (F.col("n") > 0).cast("long")), ("ends", F.when(is_end, F.col("n"))))]).first()
    tokens, distinct, trained = sums["n"], sums["v"], sums["ends"]
    words = counted.where(~is_end)
    model = Model(learn(words, vocab), tokens, distinct)
    end = model.end(trained)
    scores = materialise(word_scores(words, model), "lm-scores")
    top = scores.where(F.col("m") >= most_frequent(scores, hot)).drop("m").toArrow()
    sums_of = np.stack([top["known"].to_numpy().astype(np.float64), top["base"].to_numpy(), top["lm"].to_numpy()]) if len(top) else np.zeros((3, 0))
    frequent = docs.sparkSession.sparkContext.broadcast((top["word"].to_pylist(), sums_of))
    del top
    norm = log10(tokens + distinct + 1)
    end_base, end_known = log10(trained + 1.0), int(trained > 0)

    def split(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words_, sums_ = frequent.value
        place = dict(zip(words_, range(len(words_)))).get
        row = TaskContext.get().partitionId() << 33
        for b in it:
            cols: dict[str, list] = {k: [] for k in ("row", "word", "times", "id", "held", "tokens", "known", "base", "lm")}
            for ident, held, text in zip(b.column("lm_id").to_pylist(), b.column("lm_held").to_pylist(), _texts(b, "lm_text")):
                counts = Counter(words_of(text))
                at = np.fromiter(map(place, counts, repeat(-1)), dtype=np.int64, count=len(counts))
                times = np.fromiter(counts.values(), dtype=np.int64, count=len(counts))
                here = at >= 0
                known, base, lm = (sums_[:, at[here]] @ times[here]).tolist()
                n, known, base, lm = 1 + int(times.sum()), int(known) + end_known, base + end_base, lm + end
                rare = list(compress(counts, ~here)) if not here.all() else []
                k = len(rare)
                cols["row"] += [row] * (k + 1)
                cols["word"] += rare
                cols["word"].append(b" %d" % row)  # matches no word: the document's own row
                cols["times"] += [counts[w] for w in rare] + [0]
                for name, value in (("id", ident), ("held", held), ("tokens", n), ("known", known), ("base", base - n * norm), ("lm", lm)):
                    cols[name] += [None] * k + [value]
                row += 1
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(cols.values(), kinds)], names=list(cols))

    schema = "row long, word binary, times long, id long, held boolean, tokens long, known long, base double, lm double"
    parts_ = slim.withColumn("lm_id", F.col("lm_id").cast("long")).mapInArrow(split, schema)
    entry = scores.select("word", F.col("known").alias("w_known"), F.col("base").alias("w_base"), F.col("lm").alias("w_lm"))
    joined = parts_.join(entry, "word", "left").select(
        "row", "id", "held", "tokens",
        F.coalesce("known", F.when(F.col("w_known"), F.col("times")).otherwise(0)).alias("known"),
        F.coalesce("base", F.col("times") * F.col("w_base")).alias("base"),
        F.coalesce("lm", F.col("times") * F.col("w_lm")).alias("lm"),
    )
    return joined.groupBy("row").agg(
        F.max("id").alias(id_col),
        F.max("held").alias("held_out"),
        F.max("tokens").alias("n_tokens"),
        F.sum("known").cast("long").alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        F.sum("base").alias("base_score"),
        F.sum("lm").alias("score"),
    ).drop("row")
