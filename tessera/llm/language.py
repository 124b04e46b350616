"""Language ID by unigram pieces, summed over all segmentations.

The vocabulary is a public tokenizer's and fixed. For each language a probability over its pieces is learned; a word's
probability is the sum over every way to cut it into pieces (forward algorithm), a text's the product over its words.
"""

from __future__ import annotations

import math
import uuid
from collections import Counter
from collections.abc import Iterator
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.text import map_batches, raw_texts

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MAX_PIECE, FLOOR = 12, 1e-9
#: Letters with a dense table; letters of a long word that are stepped through together.
COMMON, LONG = 96, 256
#: Tokens, and bytes of them, that a worker keeps with their scores; beyond that it starts anew, which changes time alone.
CACHE, CACHE_BYTES = 400_000, 32 << 20


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """Pieces made of letters, lower-cased, the word-start mark off; in natural order, each once."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {p for i in range(sp.get_piece_size()) if (p := sp.id_to_piece(i).lstrip("▁").lower()).isalpha() and len(p) <= MAX_PIECE}
    return sorted(found)


def letters(token: bytes) -> str:
    w = token.decode("utf-8", "replace").lower()
    return w if w.isalpha() else "".join(c for c in w if c.isalpha())


class PieceModel:
    """``p``: languages x pieces. A letter outside the vocabulary is a piece of its own with the floor probability."""

    def __init__(self, languages: list[str], pieces: list[str], p: np.ndarray) -> None:
        self.languages, self.pieces, self.p = languages, pieces, p
        self.ids = {w: i for i, w in enumerate(pieces)}
        self.starts = {w[:n] for w in pieces for n in range(1, len(w) + 1)}
        # pieces as a trie: state and letter class to state; 0 is the dead state, 1 the root, class 0 any other letter.
        # The COMMON most frequent letters have a dense table, arcs of the others are searched
        letters_ = [c for c, _ in sorted(Counter(c for w in pieces for c in w).items(), key=lambda x: (-x[1], x[0]))]
        self.classes = np.zeros(0x110000, np.int32)
        self.classes[[ord(c) for c in letters_]] = np.arange(1, len(letters_) + 1)
        states = {"": 1}
        for w in pieces:
            for n in range(1, len(w) + 1):
                states.setdefault(w[:n], len(states) + 1)
        self.dense = np.zeros((len(states) + 1, COMMON + 1), np.int32)
        self.piece = np.full(len(states) + 1, len(pieces), np.int32)
        rare = [(0, 0)]
        for w, s in states.items():
            if w:
                c = int(self.classes[ord(w[-1])])
                if c < COMMON:
                    self.dense[states[w[:-1]], c] = s
                else:
                    rare.append((states[w[:-1]] << 32 | c, s))
                self.piece[s] = self.ids.get(w, len(pieces))
        self.rare, self.rare_to = (np.array(x, np.int64) for x in zip(*sorted(rare), strict=True))
        # rows: each piece, no piece, a letter that is no piece
        self.rows = np.vstack([p.T, np.zeros(len(p)), np.full(len(p), FLOOR)])

    def step(self, state: np.ndarray, c: np.ndarray) -> np.ndarray:
        """The trie's states one letter on."""
        out = self.dense[state, np.minimum(c, COMMON)]
        at = np.flatnonzero((c >= COMMON) & (state > 0))
        if len(at):
            key = state[at].astype(np.int64) << 32 | c[at]
            i = np.minimum(np.searchsorted(self.rare, key), len(self.rare) - 1)
            out[at] = np.where(self.rare[i] == key, self.rare_to[i], 0)
        return out

    def arcs(self, word: str) -> list[tuple[int, int, int]]:
        """(from, to, piece) of every piece in the word, by start; -1: a letter that is no piece."""
        n = len(word)
        if n <= LONG:  # plain look-ups are quicker than arrays of a few letters
            out, ids, starts = [], self.ids, self.starts
            for a in range(n):
                i = ids.get(word[a], -1)
                out.append((a, a + 1, i))
                for b in range(a + 2, min(n, a + MAX_PIECE) + 1):
                    part = word[a:b]
                    if part not in starts:
                        break
                    i = ids.get(part)
                    if i is not None:
                        out.append((a, b, i))
            return out
        codes = np.zeros(n + MAX_PIECE, np.int32)
        codes[:n] = self.classes[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
        state, found = np.ones(n, np.int32), []
        for j in range(1, MAX_PIECE + 1):
            state = self.step(state, codes[j - 1 : j - 1 + n])
            i = self.piece[state]
            i[i == len(self.pieces)] = -1
            at = np.flatnonzero(i >= 0) if j > 1 else np.arange(n)
            found.append(np.stack([at, at + j, i[at]]))
        every = np.concatenate(found, axis=1)
        return list(map(tuple, every[:, np.argsort(every[0], kind="stable")].T.tolist()))

    def _steps(self, codes: np.ndarray, ahead: np.ndarray, shift: np.ndarray, upto: int) -> np.ndarray:
        """Move sums forward by ``upto`` letters, all rows at once.

        ``codes``: rows x letters, MAX_PIECE zeros (or the letters that follow) at the end. ``ahead``: rows x ... x
        languages x MAX_PIECE, what is summed so far for the place reached and those after it. ``shift``: logarithms
        taken out of ``ahead`` on the way, so that it neither vanishes nor loses digits.
        """
        between = (1,) * (ahead.ndim - 3)
        for t in range(upto):
            now = ahead[..., 0].copy()
            ahead[..., :-1] = ahead[..., 1:]
            ahead[..., -1] = 0.0
            state = np.ones(len(codes), np.int32)
            for j in range(MAX_PIECE):
                state = self.step(state, codes[:, t + j])
                i = self.piece[state]
                if j == 0:
                    i = np.where(i == len(self.pieces), len(self.pieces) + 1, i)
                elif not state.any():
                    break
                ahead[..., j] += now * self.rows[i].reshape(len(codes), *between, -1)
            if t % 16 == 15:
                top = ahead.max(axis=-1)
                low = (top > 0) & (top < 1e-60)
                if low.any():
                    by = np.where(low, top, 1.0)
                    ahead /= by[..., None]
                    shift += np.log(by)
        return ahead

    def words_logp(self, ws: list[str]) -> np.ndarray:
        """Log probability of each word in each language, over all segmentations: words x languages."""
        out = np.zeros((len(ws), len(self.languages)))
        order = sorted((i for i in range(len(ws)) if len(ws[i]) <= LONG), key=lambda i: len(ws[i]))
        for n, grp in groupby(order, key=lambda i: len(ws[i])):
            idx = list(grp)
            for s in range(0, len(idx), 4096):
                part = idx[s : s + 4096]
                codes = np.zeros((len(part), n + MAX_PIECE), np.int32)
                codes[:, :n] = self.classes[np.frombuffer("".join(ws[i] for i in part).encode("utf-32-le"), np.uint32)].reshape(len(part), n)
                ahead, shift = np.zeros((len(part), len(self.languages), MAX_PIECE)), np.zeros((len(part), len(self.languages)))
                ahead[..., 0] = 1.0
                # past a word's end there is no piece, so only whole segmentations reach it
                self._steps(codes, ahead, shift, n)
                out[part] = np.log(np.maximum(ahead[..., 0], 1e-300)) + shift
        for i in range(len(ws)):
            if len(ws[i]) > LONG:
                out[i] = self._long(ws[i])
        return out

    def _long(self, word: str) -> np.ndarray:
        """A word of any length in time linear in it: pieces of LONG letters are stepped through together, from each of
        the MAX_PIECE places at which a piece of the vocabulary may enter them, and their linear maps are applied in turn."""
        langs = len(self.languages)
        codes = np.zeros(len(word) + MAX_PIECE, np.int32)
        codes[: len(word)] = self.classes[np.frombuffer(word.encode("utf-32-le"), np.uint32)]
        v, shift = np.zeros((langs, MAX_PIECE)), np.zeros(langs)
        v[:, 0] = 1.0
        whole = len(word) // LONG
        for s in range(0, whole, 1024):
            n = min(1024, whole - s)
            rows = np.lib.stride_tricks.sliding_window_view(codes, LONG + MAX_PIECE)[s * LONG : (s + n) * LONG : LONG]
            maps, drop = np.zeros((n, MAX_PIECE, langs, MAX_PIECE)), np.zeros((n, MAX_PIECE, langs))
            maps[:, np.arange(MAX_PIECE), :, np.arange(MAX_PIECE)] = 1.0
            self._steps(rows, maps, drop, LONG)
            for m, d in zip(maps, drop, strict=True):
                top = d.max(axis=0)
                v = np.einsum("li,ilk->lk", v, m * np.exp(d - top)[..., None])
                shift += top
                by = np.where(v.max(axis=1) > 0, v.max(axis=1), 1.0)
                v /= by[:, None]
                shift += np.log(by)
        rest = codes[None, whole * LONG :]
        ahead, more = v[None].copy(), np.zeros((1, langs))
        self._steps(rest, ahead, more, len(word) - whole * LONG)
        return np.log(np.maximum(ahead[0, :, 0], 1e-300)) + shift + more[0]

    def word_logp(self, word: str) -> list[float]:
        return self.words_logp([word])[0].tolist()

    def expected(self, word: str, x: int, weight: float, into: np.ndarray) -> None:
        """Add each piece's expected count in language x (forward-backward); places are rescaled, so that length is no matter."""
        arcs, n = self.arcs(word), len(word)
        p = [float(self.p[x, i]) if i >= 0 else FLOOR for _, _, i in arcs]
        if n <= LONG:
            f, g = [1.0] + [0.0] * n, [0.0] * n + [1.0]
            for (a, b, _), q in zip(arcs, p, strict=True):
                f[b] += f[a] * q
            for (a, b, _), q in zip(reversed(arcs), reversed(p), strict=True):
                g[a] += g[b] * q
            if f[n] > 0:
                for (a, b, i), q in zip(arcs, p, strict=True):
                    if i >= 0:
                        into[x, i] += weight * f[a] * q * g[b] / f[n]
            return
        f, g = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        logs = [math.log(q) if q > 0 else -math.inf for q in p]
        for (a, b, _), q in zip(arcs, logs, strict=True):
            f[b] = _log_sum(f[b], f[a] + q)
        for (a, b, _), q in zip(reversed(arcs), reversed(logs), strict=True):
            g[a] = _log_sum(g[a], g[b] + q)
        for (a, b, i), q in zip(arcs, logs, strict=True):
            if i >= 0 and f[n] > -math.inf:
                into[x, i] += weight * math.exp(f[a] + q + g[b] - f[n])


def _log_sum(x: float, y: float) -> float:
    if x < y:
        x, y = y, x
    return x if y == -math.inf else x + math.log1p(math.exp(y - x))


def train(samples: dict[str, Counter], pieces: list[str], rounds: int = 2, smooth: float = 0.05) -> PieceModel:
    """Expectation maximisation from a flat start that favours no piece; ``samples``: words with counts by language."""
    languages = sorted(samples)
    p = np.full((max(1, len(languages)), max(1, len(pieces))), 1.0)
    size = np.array([0.02 ** max(0, 3 - len(w)) for w in pieces] or [1.0])  # longer pieces first, as their tokenizer has them
    p = p * size / size.sum()
    model = PieceModel(languages, pieces, p)
    for _ in range(rounds):
        counts = np.zeros_like(p)
        for x, lang in enumerate(languages):
            for w, n in samples[lang].items():
                model.expected(w, x, float(n), counts)
        p = (counts + smooth) / (counts.sum(axis=1, keepdims=True) + smooth * p.shape[1])
        model = PieceModel(languages, pieces, p)
    return model


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 400, vocabulary: str = VOCABULARY) -> PieceModel:
    """Learn from about ``sample`` whole texts of each language (the documented bound), those of the least hashes.

    Rows are drawn, not ids: a row's place is the hash of its id and text, rows that repeat both count once. Rows with a
    null text or language teach nothing; without any, no language is learned. What comes to the driver is words with
    their counts in the sample.
    """
    rows = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).cast("string").alias("text"), F.col(id_col).cast("string").alias("i")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").agg(F.count("*").alias("rows"))
    place = F.pmod(F.xxhash64("i", "text"), F.lit(1 << 40)) / float(1 << 40)
    drawn = rows.join(F.broadcast(sizes), "lang").where(place < sample / F.col("rows")).select("lang", "i", "text").distinct()

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for lang, text in zip(batch.column(0).to_pylist(), raw_texts(batch.column(1)), strict=True):
                own = Counter(w for t in text.split() if (w := letters(t)))
                if own:
                    yield pa.record_batch([pa.array([lang] * len(own)), pa.array(own.keys(), pa.string()), pa.array(own.values(), pa.int64())], names=["lang", "w", "n"])

    samples: dict[str, Counter] = {}
    for r in drawn.select(F.col("lang").cast("string"), "text").mapInArrow(count, "lang string, w string, n long").groupBy("lang", "w").agg(F.sum("n").alias("n")).collect():
        samples.setdefault(r["lang"], Counter())[r["w"]] = r["n"]
    return train(samples, load_pieces(vocabulary))


_MEMO: dict[str, tuple[PieceModel, dict, list]] = {}


def identify(docs: DataFrame, model: PieceModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id_col, the columns to keep, lang_pred, score for every row, repeated rows and null ids included.

    lang_pred is the language of the highest posterior (ties: the first in natural order), score that posterior; `und`
    and 0 where the text is null or has no letter, or no language was learned. Whole texts are scored, however long, in
    time linear in their length. An empty table gives no rows; other columns are not read, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.languages, model.pieces, model.p))
    key = uuid.uuid4().hex
    keep = keep or []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if key not in _MEMO:
            _MEMO.clear()
            m = PieceModel(*shared.value)
            _MEMO[key] = (m, {}, [np.zeros((0, len(m.languages))), 0])
        m, index, held = _MEMO[key]
        langs = len(m.languages)
        texts = [t.split() if t else [] for t in raw_texts(batch.column(batch.num_columns - 1))]
        if len(index) > CACHE or held[1] > CACHE_BYTES:
            index.clear()
            held[:] = [np.zeros((0, langs)), 0]
        new = list(set().union(*texts) - index.keys()) if langs else []
        if new:  # distinct words once, as most tokens are a word with other marks or capitals
            as_word = list(map(letters, new))
            ws = list(set(as_word) - {""})
            at = dict(zip(ws, range(len(ws)), strict=True))
            logs = np.vstack([m.words_logp(ws), np.zeros(langs)])
            index.update(zip(new, range(len(held[0]), len(held[0]) + len(new)), strict=True))
            # a token without letters has zeros, a word never has: its probability is below 1 in every language
            held[0] = np.vstack([held[0], logs[[at.get(w, len(ws)) for w in as_word]]])
            held[1] += sum(map(len, new))
        n = np.array([len(t) for t in texts])
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        if langs and n.sum():
            ids = np.fromiter(map(index.__getitem__, chain.from_iterable(texts)), np.int64, int(n.sum()))
            own = held[0][ids]
            some = n > 0
            starts = np.cumsum(np.append(0, n[some]))[:-1]
            total = np.add.reduceat(own, starts)
            said = np.logical_or.reduceat((own < 0).any(axis=1), starts)
            best = total.argmax(axis=1)
            posterior = 1.0 / np.exp(np.maximum(-700.0, total - total.max(axis=1, keepdims=True))).sum(axis=1)
            for r, ok, b, p in zip(np.flatnonzero(some).tolist(), said.tolist(), best.tolist(), posterior.tolist(), strict=True):
                if ok:
                    pred[r], score[r] = m.languages[b], p
        return pa.record_batch([*batch.columns[:-1], pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[id_col, *keep, "lang_pred", "score"])

    kept = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("__text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return map_batches(kept, run, f"{schema}, lang_pred string, score double")
