"""Operator 3, SentencePiece encoding and decoding with N-best segmentation.

A text's lattice has the vocabulary's pieces as edges. No piece goes on from another character to a space mark, so
the lattice of a text is a row of independent lattices, one for each run of spaces with the word after it (a line break
begins a word of its own). A vocabulary with other pieces is refused.

1. Forward Viterbi scores of all distinct words of a slice at once, as arrays.
2. The best path. A second-best path of a word leaves the best path at one edge, which gives the word's gap.
3. N-best: the n - 1 words of a text with the smallest gaps hold all that its n best paths can change. Their n best
   paths come from a backward A* search from the word's end, with the forward scores as exact heuristic; each time the
   start is reached the next best path is complete. The text's n best are the best sums.

The vocabulary holds merge ranks, not probabilities; a piece of rank r scores -log(1 + r) - `PIECE_COST`
(Zipf's law). A character that no piece holds is spelt in byte pieces.

Defined cases: null and empty texts have one path without pieces; a literal space mark counts as a space, so round_trip is false for such a text; ties go to
the path whose last pieces are longer; a very long text is held alone, and a very long word takes a step for each of its
characters, in memory of its own size; repeated rows are encoded each; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import heapq
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.llm.common import in_batches, mix64, resident, slices, spread, text_of

SPACE = "▁"
#: Stands between words.
CUT = "\x02"
#: A line break, or a run of spaces with what follows it.
WORD = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")
#: Sums nearer to each other than this are ties.
TIE = 1e-9
PIECE_COST = 4.0
UNKNOWN = -30.0
WIDTHS = (6, 9, 12, 16, 24, 40)


class Vocabulary:
    """Pieces of a sentencepiece model file, with their scores and bytes."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        count = model.get_piece_size()
        self.scores, self.ids, self.data, self.bytes = {}, {}, [b""] * count, {}
        for i in range(count):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes[int(piece[3:5], 16)] = i
                self.data[i] = bytes([int(piece[3:5], 16)])
            elif not model.is_control(i) and not model.is_unknown(i):
                self.data[i] = piece.replace(SPACE, " ").encode()
                self.ids[piece], self.scores[piece] = i, -math.log1p(min(-model.get_score(i), count)) - PIECE_COST
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in self.ids):
            raise ValueError(f"{path} has pieces that go on over a line break or to a space mark")
        self.longest = max(map(len, self.ids))
        points = [np.frombuffer(p.encode("utf-32-le"), np.uint32) for p in self.ids]
        hashes = np.array([self._hash(p) for p in points], np.uint64)
        order = np.argsort(hashes)
        self.hashes = hashes[order]
        self.hashed_ids = np.fromiter(self.ids.values(), np.int32, len(self.ids))[order]
        self.hashed_scores = np.fromiter(self.scores.values(), np.float64, len(self.scores))[order]
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[self.hashes >> np.uint64(42)] = True

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        return (h ^ c) * np.uint64(0x9E3779B97F4A7C15) + (h >> np.uint64(29))

    def _hash(self, points: np.ndarray) -> int:
        h = np.full(1, 0x2545F4914F6CDD1D, np.uint64)
        for c in points.astype(np.uint64):
            h = self.step(h, np.array([c], np.uint64))
        return int(mix64(h)[0])

    def spelt(self, char: str) -> list[int]:
        return [self.bytes[b] for b in char.encode()]

    def edges(self, word: str, end: int):
        """(start, score) of the edges that end at `end`, longest first."""
        for start in range(max(0, end - self.longest), end):
            score = self.scores.get(word[start:end])
            if score is not None:
                yield start, score
            elif end - start == 1:
                yield start, UNKNOWN

    def ids_of(self, word: str, cuts: list[int]) -> list[int]:
        out: list[int] = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            found = self.ids.get(word[a:b])
            out += self.spelt(word[a:b]) if found is None else [found]
        return out


def forward(word: str, vocabulary: Vocabulary) -> tuple[list[float], list[int]]:
    """(best score up to each place, where the last edge of it begins)."""
    best, back = [0.0] + [-math.inf] * len(word), [0] * (len(word) + 1)
    for end in range(1, len(word) + 1):
        sums = [(start, best[start] + score) for start, score in vocabulary.edges(word, end)]
        best[end] = max(s for _, s in sums)
        back[end] = next(start for start, s in sums if s >= best[end] - TIE)
    return best, back


def nbest(word: str, vocabulary: Vocabulary, n: int, best: list[float] | None = None) -> list[tuple[float, list[int]]]:
    """The n best (score, cuts from 0 to the word's length), by backward A* search with exact heuristic."""
    best = best or forward(word, vocabulary)[0]
    found, count = [], 0
    # minus (forward score + score behind), place, order of pushing, score behind, path behind; of paths that are equal but
    # for rounding the one nearest the start goes on, or a run of one character would open them all
    heap = [(-round(best[-1], 6), len(word), 0, 0.0, None)]
    while heap and len(found) < n:
        _, at, _, behind, path = heapq.heappop(heap)
        if at == 0:
            cuts = [0]
            while path:
                cuts.append(path[0])
                path = path[1]
            found.append((behind, cuts))
            continue
        for start, score in vocabulary.edges(word, at):
            count += 1
            heapq.heappush(heap, (-round(best[start] + score + behind, 6), start, count, score + behind, (at, path)))
    return found


class Segmenter:
    """Best paths of words as arrays, and n best paths of texts."""

    def __init__(self, vocabulary: Vocabulary, n: int, room: int = 50_000):
        self.vocabulary, self.n, self.room, self.paths = vocabulary, n, room, {}

    def alternatives(self, word: str) -> list[tuple[float, list[int]]]:
        found = self.paths.get(word)
        if found is None:
            found = [(s, self.vocabulary.ids_of(word, c)) for s, c in nbest(word, self.vocabulary, self.n)]
            if len(self.paths) < self.room:
                self.paths[word] = found
        return found

    def _vector(self, words: list[str], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(scores, gaps, ids one word after another, how many each has) of words of at most width characters."""
        v, count = self.vocabulary, len(words)
        sizes = np.fromiter(map(len, words), np.int64, count)
        flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        points = np.zeros((count, width), np.uint64)
        points[np.arange(width)[None] < sizes[:, None]] = flat
        h = np.full((count, width), 0x2545F4914F6CDD1D, np.uint64)
        most = min(width, v.longest)
        edge = np.full((most, count, width + 1), -np.inf)  # length - 1, word, end
        piece = np.full((most, count, width + 1), -1, np.int32)
        for length in range(1, most + 1):
            h = v.step(h[:, : width - length + 1], points[:, length - 1 :])
            mixed = mix64(h)
            maybe = v.sieve[mixed >> np.uint64(42)] & (np.arange(length, width + 1)[None] <= sizes[:, None])
            w, s = np.nonzero(maybe)
            place = np.minimum(np.searchsorted(v.hashes, mixed[w, s]), len(v.hashes) - 1)
            hit = v.hashes[place] == mixed[w, s]
            w, s, place = w[hit], s[hit], place[hit]
            edge[length - 1, w, s + length], piece[length - 1, w, s + length] = v.hashed_scores[place], v.hashed_ids[place]
        inside = np.arange(1, width + 1)[None] <= sizes[:, None]
        edge[0, :, 1:] = np.where(inside & (piece[0, :, 1:] < 0), UNKNOWN, edge[0, :, 1:])
        best, back = np.full((count, width + 1), -np.inf), np.zeros((count, width + 1), np.int64)
        best[:, 0] = 0
        rows = np.arange(count)
        second = np.full((count, width + 1), np.inf)  # how much less the next best last edge gives
        for end in range(1, width + 1):
            k = min(end, most)
            values = np.stack([best[:, end - length] + edge[length - 1, :, end] for length in range(k, 0, -1)], axis=1)
            best[:, end] = values.max(axis=1)
            first = (values >= best[:, end, None] - TIE).argmax(axis=1)
            back[:, end] = k - first
            if k > 1:
                values[rows, first] = -np.inf
                with np.errstate(invalid="ignore"):
                    second[:, end] = best[:, end] - values.max(axis=1)
        at, gap, lengths, pieces, active = sizes.copy(), np.full(count, np.inf), [], [], rows
        while len(active):
            active = active[at[active] > 0]
            end = at[active]
            gap[active] = np.minimum(gap[active], second[active, end])
            length = back[active, end]
            pieces.append((active, piece[length - 1, active, end], end - length))
            at[active] -= length
        word = np.concatenate([p[0] for p in pieces])
        ids, start = np.concatenate([p[1] for p in pieces]), np.concatenate([p[2] for p in pieces])
        order = np.lexsort((start, word))
        word, ids, start = word[order], ids[order].astype(np.int64), start[order]
        lengths = np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            spelt = [v.spelt(words[w][s]) for w, s in zip(word[unknown], start[unknown], strict=True)]
            lengths[unknown] = [len(x) for x in spelt]
            out = np.empty(int(lengths.sum()), np.int64)
            first = np.cumsum(lengths) - lengths
            known = ids >= 0
            out[first[known]] = ids[known]
            out[spread(first[unknown], lengths[unknown])] = [b for x in spelt for b in x]
            ids = out
        each = np.bincount(word, weights=lengths, minlength=count).astype(np.int64)
        return best[rows, sizes], gap, ids, each

    def words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The same for words of any length; (scores, gaps, ids, counts)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        scores, gaps, counts = np.zeros(len(words)), np.full(len(words), np.inf), np.zeros(len(words), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        low = 0
        for width in WIDTHS:
            for these in np.array_split(own := np.flatnonzero((sizes > low) & (sizes <= width)), max(1, len(own) // 50_000)):
                if len(these):
                    scores[these], gaps[these], ids, counts[these] = self._vector([words[i] for i in these], width)
                    parts.append((these, ids))
            low = width
        for i in np.flatnonzero(sizes > low):
            best, back = forward(words[i], self.vocabulary)
            cuts, gap = [sizes[i]], math.inf
            while cuts[-1]:
                end = int(cuts[-1])
                others = [best[end] - best[s] - x for s, x in self.vocabulary.edges(words[i], end) if s != back[end]]
                gap = min([gap, *others])
                cuts.append(back[end])
            ids = self.vocabulary.ids_of(words[i], [int(c) for c in cuts[::-1]])
            scores[i], gaps[i], counts[i] = best[-1], gap, len(ids)
            parts.append((np.array([i]), np.array(ids, np.int64)))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int64)
        for these, ids in parts:
            out[spread(starts[these], counts[these])] = ids
        return scores, gaps, out, counts

    def texts(self, texts: pa.Array):
        """For each text: (ids, [(score, ids' CRC) of the n best])."""
        normal = pc.replace_substring(pc.replace_substring(texts, SPACE, " "), " ", CUT + SPACE)
        normal = pc.binary_join_element_wise(SPACE, pc.replace_substring(normal, "\n", f"{CUT}\n{CUT}"), "")
        for _ in range(2):  # pairs of space marks first, then the pairs
            normal = pc.replace_substring(normal, SPACE + CUT + SPACE, SPACE + SPACE)
        tokens = pc.split_pattern(normal, CUT)
        marked = np.asarray(pc.match_substring(texts, CUT))
        if marked.any():  # the cut itself is in a text
            rows = tokens.to_pylist()
            for i in np.flatnonzero(marked):
                rows[i] = WORD.findall(SPACE + texts[i].as_py().replace(" ", SPACE))
            tokens = pa.array(rows, pa.list_(pa.string()))
        offsets = np.concatenate(([0], np.cumsum(np.asarray(pc.list_value_length(tokens), dtype=np.int64))))
        coded = tokens.flatten().dictionary_encode()
        numbers = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        words = coded.dictionary.to_pylist()
        scores, gaps, ids, counts = self.words(words)
        starts = np.cumsum(counts) - counts
        empty = np.asarray(pc.equal(pc.binary_length(texts), 0))
        for i in range(len(texts)):
            if empty[i]:
                yield np.zeros(0, np.int64), [(0.0, zlib.crc32(b""))]
                continue
            own = numbers[offsets[i] : offsets[i + 1]]
            each = counts[own]
            mine = ids[spread(starts[own], each)]
            yield mine, self._nbest(own, words, scores, gaps, mine, each)

    def _nbest(self, own: np.ndarray, words: list[str], scores: np.ndarray, gaps: np.ndarray, ids: np.ndarray, each: np.ndarray) -> list[tuple[float, int]]:
        crc = lambda x: zlib.crc32(x.astype("<u4").tobytes())
        total = float(scores[own].sum())
        gap = gaps[own]
        k = min(self.n - 1, len(own))
        near = np.argpartition(gap, k - 1)[:k] if k else np.zeros(0, int)
        near = np.sort(near[np.isfinite(gap[near])])
        lists = [self.alternatives(words[own[p]]) for p in near]
        heap, seen, out = [(0.0, (0,) * len(near))], {(0,) * len(near)}, []
        ends = np.cumsum(each)
        while heap and len(out) < self.n:
            less, choice = heapq.heappop(heap)
            changed = ids
            for p, c, options in sorted(zip(near, choice, lists, strict=True), key=lambda x: -x[0]):
                if c:
                    changed = np.concatenate((changed[: ends[p] - each[p]], options[c][1], changed[ends[p] :]))
            out.append((total - less, crc(changed)))
            for j, options in enumerate(lists):
                if choice[j] + 1 < len(options):
                    more = (*choice[:j], choice[j] + 1, *choice[j + 1 :])
                    if more not in seen:
                        seen.add(more)
                        heapq.heappush(heap, (less + options[choice[j]][0] - options[choice[j] + 1][0], more))
        return out


def decoded(ids, vocabulary: Vocabulary) -> str:
    """The text of ids; the space that encoding puts in front goes."""
    return b"".join(map(vocabulary.data.__getitem__, ids)).decode(errors="replace")[1:]


def segmenter_of(model_path: str, n: int) -> Segmenter:
    """One for each Python worker."""
    return resident(("segmenter", model_path, n), lambda: Segmenter(Vocabulary(model_path), n))


def nbest_digest(docs: DataFrame, model_path: str, n: int = 4, slice_bytes: int = 4 << 20) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, best_score, nbest_scores, nbest_crc32 and round_trip of each text."""

    def run(batches):
        segmenter = segmenter_of(model_path, n)
        names = ["doc_id", "n_pieces", "ids_crc32", "best_score", "nbest_scores", "nbest_crc32", "round_trip"]
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.bool_())
        for batch in batches:
            doc_ids, out = batch.column(0).to_pylist(), []
            for first, texts in slices(batch.column(1), slice_bytes):
                for k, (ids, paths) in enumerate(segmenter.texts(texts)):
                    same = decoded(ids.tolist(), segmenter.vocabulary) == texts[k].as_py()
                    rounded = [round(s, 6) for s, _ in paths]
                    out.append((doc_ids[first + k], len(ids), paths[0][1], rounded[0], rounded, [c for _, c in paths], same))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[i]) for i in range(7)], names=names)

    schema = "doc_id long, n_pieces long, ids_crc32 long, best_score double, nbest_scores array<double>, nbest_crc32 array<long>, round_trip boolean"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text")).transform(in_batches(run, schema, keeps=("segmenter", model_path, n)))
