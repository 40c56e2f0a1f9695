"""SentencePiece encoding with the n best segmentations, and decoding.

A text's pieces form a lattice. A forward Viterbi pass scores the best way to reach each place; these scores are the exact
heuristic of an A-star search that runs backward from the end, so it meets complete segmentations best first. Where no
piece of the vocabulary crosses a place, the lattice falls apart there: each segment is searched by itself, once for all its
occurrences that a worker remembers, and the segments' lists are merged exactly into those of the text.

Scores are those that the vocabulary file states; a segmentation's score is their sum. Characters without a piece become the bytes
of their UTF-8 form at the cost of the rarest piece and ten more. So does the space mark itself where a text has it as a character,
which makes decoding exact.
"""

from __future__ import annotations

import heapq
import re
from bisect import insort
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SPACE = "▁"
#: The vocabulary file, a parameter everywhere.
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations of a text.
N_BEST = 4
#: Segments remembered by a worker, and the longest that are.
REMEMBERED, LONGEST_REMEMBERED = 250_000, 48
#: Characters of texts that are encoded together (or one text), and of segments that are searched together.
TOGETHER, SEARCHED = 1 << 19, 1 << 15
#: Searches for n that a worker remembers.
SEARCHES = 10_000
UNKNOWN_COST = 10.0


def _segments(pieces: list[str]) -> str:
    """A pattern for the parts of a text between places that no piece crosses: before each run of spaces, around line ends, and
    between words and marks. Marks are ASCII punctuation and digits and whatever a piece joins to them; if pieces join letters to
    marks there are fewer places, and if they hold spaces inside there are none."""
    if any(SPACE in p.lstrip(SPACE) for p in pieces):
        return "(?s).+"
    marks = set("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~0123456789")
    while True:
        more = {x for p in pieces for pair in pairwise(p) if SPACE not in pair and (pair[0] in marks) != (pair[1] in marks) for x in pair} - marks
        if not more:
            break
        marks |= more
    alone = "" if any("\n" in p and len(p) > 1 for p in pieces) else "\n"
    some = re.escape("".join(sorted(marks - {"\n"} if alone else marks)))
    return f" *[^ {alone}{some}]+| *[{some}]+| +" + "|\n" * bool(alone)


class Steps:
    """The tree of pieces as arrays: a node's child at a character's class is `child` at the node's base plus the class, if `owner` is the node there."""

    def __init__(self, tree: dict):
        nodes, children = [tree], []
        for node in nodes:
            own = [(char, child) for char, child in node.items() if char != 0]
            children.append([(char, len(nodes) + k) for k, (char, _) in enumerate(own)])
            nodes += [child for _, child in own]
        chars = sorted({ord(char) for own in children for char, _ in own})
        #: Of each code point a class, 0 for all that no piece has.
        self.classes = np.zeros(max(chars, default=0) + 2, np.int32)
        self.classes[chars] = np.arange(1, len(chars) + 1)
        self.base = np.zeros(len(nodes), np.int32)
        taken = bytearray(sum(map(len, children)) * 2 + 2 * len(chars) + 2)
        at, owners, targets, free, begin = [], [], [], 0, 0
        number = {chr(c): k for k, c in enumerate(chars, 1)}
        for k in sorted(range(len(nodes)), key=lambda k: -len(children[k])):
            if not children[k]:
                break
            own = sorted((number[char], child) for char, child in children[k])
            least = own[0][0]
            free = taken.find(0, free)
            # Nodes with several children don't try again where many places were taken.
            slot, tries = taken.find(0, max(begin if len(own) > 1 else free, least)), 0
            while len(own) > 1 and any([taken[slot - least + c] for c, _ in own]):
                slot, tries = taken.find(0, slot + 1), tries + 1
            if tries > 20:
                begin = slot
            self.base[k] = slot - least
            if slot + 2 * len(chars) + 2 >= len(taken):
                taken += bytes(len(taken))
            for c, child in own:
                where = slot - least + c
                taken[where] = 1
                at.append(where)
                owners.append(k)
                targets.append(child)
        self.owner = np.full(max(at, default=0) + len(chars) + 2, -1, np.int32)
        self.child = np.zeros(len(self.owner), np.int32)
        self.owner[at], self.child[at] = owners, targets
        #: Of each node the piece that ends there, or -1, and its score.
        self.piece = np.array([n[0][0][0] if 0 in n else -1 for n in nodes], np.int32)
        self.score = np.array([n[0][1] if 0 in n else 0.0 for n in nodes])
        depth = [0] * len(nodes)
        for k, own in enumerate(children):
            for _, child in own:
                depth[child] = depth[k] + 1
        self.longest = max(depth[-1], 1)

    def next(self, nodes: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes' children, and whether they exist."""
        slots = self.base[nodes] + classes
        return self.child[slots], self.owner[slots] == nodes


class Pieces:
    """The vocabulary: pieces with scores, bytes to fall back on, and where lattices fall apart."""

    def __init__(self, pieces: list[tuple[str, float, str]]):
        """pieces: by id, (piece, score, kind), kind one of normal, byte, unknown, control."""
        #: A tree of dictionaries by character; where a piece ends, 0 leads to its (ids, score).
        self.tree: dict = {}
        self.byte_ids: dict[int, int] = {}
        self.raw: list[bytes] = []
        self.unknown = 0
        normal = []
        for k, (piece, score, kind) in enumerate(pieces):
            self.raw.append(b"")
            if kind == "byte":
                self.byte_ids[int(piece[1:-1], 16)] = k
                self.raw[k] = bytes([int(piece[1:-1], 16)])
            elif kind == "unknown":
                self.unknown = k
                self.raw[k] = "�".encode()
            elif kind == "normal" and piece:
                normal.append((piece, float(score), k))
                self.raw[k] = piece.replace(SPACE, " ").encode()
        for piece, score, k in normal:
            node = self.tree
            for char in piece:
                node = node.setdefault(char, {})
            node[0] = (k,), score
        self.floor = min((s for _, s, _ in normal), default=0.0) - UNKNOWN_COST
        self.steps = Steps(self.tree)
        self.raw_size = np.array(list(map(len, self.raw)), np.int64)
        self.segment = re.compile(_segments([p for p, _, _ in normal]))

    @classmethod
    def of_file(cls, path: str = MODEL_FILE) -> Pieces:
        """Read on the driver; executors get it by broadcast, and need neither the file nor its library."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)

        def kind(k):
            return "byte" if sp.is_byte(k) else "unknown" if sp.is_unknown(k) else "control" if sp.is_control(k) or sp.is_unused(k) else "normal"

        return cls([(sp.id_to_piece(k), sp.get_score(k), kind(k)) for k in range(sp.get_piece_size())])

    def _fallback(self, char: str) -> tuple[int, ...]:
        data = char.encode("utf-8", "surrogatepass")
        return tuple(self.byte_ids[b] for b in data) if all(b in self.byte_ids for b in data) else (self.unknown,)

    @staticmethod
    def _marked(segment: str) -> str:
        """As pieces write it. A space mark in the text is no space: it gets a character that no piece has."""
        return segment.replace(SPACE, "\0").replace(" ", SPACE) if SPACE in segment else segment.replace(" ", SPACE)

    def _forward(self, segment: str) -> tuple[list[float], list[list]]:
        """The Viterbi pass: of each place the best score of reaching it, and the arcs that end there (start, ids, score), the longest first."""
        size, marked = len(segment), self._marked(segment)
        best = [0.0] + [float("-inf")] * size
        arcs: list[list] = [[] for _ in range(size + 1)]
        first, floor = self.tree.get, self.floor
        for i in range(size):
            at, j = best[i], i + 1
            node = first(marked[i])
            if node is None or 0 not in node:
                ids, score = self._fallback(segment[i]), floor
            else:
                ids, score = node[0]
            arcs[j].append((i, ids, score))
            score += at
            if score > best[j]:
                best[j] = score
            while node is not None and j < size:
                node = node.get(marked[j])
                j += 1
                if node is not None and 0 in node:
                    ids, score = node[0]
                    arcs[j].append((i, ids, score))
                    score += at
                    if score > best[j]:
                        best[j] = score
        return best, arcs

    def search(self, segment: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The n best segmentations (all, if fewer), best first: score, ids. segment: spaces as in the text.

        Backward A-star: what is done from the end plus the forward score of the rest. Of equal ones shorter last pieces come first. As that score is exact, each open way stands
        for segmentations of its own of which one has its cost: no more ways are kept open than segmentations are still to be found, and for the last one its way is followed by
        the best arcs.
        """
        best, arcs = self._forward(segment)
        found: list[tuple] = []
        count, wanted = 0, n
        open_ways: list[tuple] = [(-best[-1], 0, len(segment), 0.0, ())]
        while open_ways:
            cost, _, at, done, path = open_ways.pop(0)
            if wanted == 1:
                while at:
                    most = float("-inf")
                    for i, ids, score in arcs[at]:
                        if best[i] + score >= most:
                            most, start, more, own = best[i] + score, i, ids, score
                    at, done, path = start, done + own, (more, path)
            if not at:
                ids = []
                while path:
                    ids += path[0]
                    path = path[1]
                found.append((-cost, tuple(ids)))
                wanted -= 1
                if not wanted:
                    break
                del open_ways[wanted:]
                continue
            for i, ids, score in arcs[at]:
                score += done
                cost = -(best[i] + score)
                if len(open_ways) < wanted or cost <= open_ways[-1][0]:
                    count -= 1
                    insort(open_ways, (cost, count, i, score, (ids, path)))
                    del open_ways[wanted:]
        return found

    def first_two(self, segment: str) -> tuple[tuple[int, ...], float, float | None, bool]:
        """The best segmentation's ids and score, what the second best loses against it (None: there is none), and whether the ids decode to the segment.

        It is search() for two, up to the score of the second: one way is followed, and of all others only the best need stay open, as its score is exact.
        """
        best, arcs = self._forward(segment)
        at, done, other = len(segment), 0.0, float("-inf")
        nothing = other
        parts: list[tuple] = []
        while at:
            most = nothing
            for arc in arcs[at]:
                score = best[arc[0]] + arc[2]
                if score >= most:
                    if most + done > other:
                        other = most + done
                    most, chosen = score, arc
                elif score + done > other:
                    other = score + done
            at, more, score = chosen
            done += score
            parts.append(more)
        ids = sum(reversed(parts), ())
        exact = b"".join([self.raw[k] for k in ids]) == segment.encode("utf-8", "surrogatepass")
        return ids, best[-1], max(0.0, best[-1] - other) if other > nothing else None, exact

    def decode(self, ids) -> str:
        """The text of ids. The space that encoding puts first goes."""
        raw = self.raw
        data = b"".join([raw[k] for k in ids])
        return (data[1:] if data[:1] == b" " else data).decode("utf-8", "replace")

    def first_twos(self, segments: list[str]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """first_two() of many segments, none of them empty: the segments by length, the ids of all, how many are of each, scores, losses (infinite: there is no second), and whether the ids decode.

        The same sums, a place of all segments at a time. Segments whose best way needs bytes are searched one by one.
        """
        segments = sorted(segments, key=len, reverse=True) if len(segments) > 1 else segments
        steps, text = self.steps, "".join(segments)
        codes = np.frombuffer(self._marked(text).encode("utf-32-le", "surrogatepass"), np.uint32)
        classes = steps.classes[np.minimum(codes, len(steps.classes) - 1)]
        sizes = np.array(list(map(len, segments)))
        longest = min(steps.longest, int(sizes[0]))
        # Each segment has a place more than characters; so many as a piece is long lie before all.
        of = np.repeat(np.arange(len(segments)), sizes)
        first = np.cumsum(sizes) - sizes + np.arange(len(segments)) + longest
        place = np.arange(len(codes)) + of + longest
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))
        met: list[tuple] = []
        at = np.arange(len(codes))
        node, there = steps.next(np.zeros(len(codes), np.int32), classes)
        for n in range(longest):
            at, node = at[there], node[there]
            ends = steps.piece[node] >= 0
            met.append((place[at[ends]] + n + 1, node[ends]))
            more = left[at] > n + 1
            at, node = at[more], node[more]
            if not len(at):
                break
            node, there = steps.next(node, classes[at + n + 1])
        longest = len(met)
        #: By place where a piece ends and its length less one.
        score = np.full((int(first[-1] + sizes[-1]) + 1, longest), float("-inf"))
        piece = np.full(score.shape, -1, np.int32)
        score[place + 1, 0] = self.floor
        for n, (ends, node) in enumerate(met):
            score[ends, n] = steps.score[node]
            piece[ends, n] = steps.piece[node]
        back = np.arange(1, longest + 1)
        best = np.full(len(score), float("-inf"))
        best[first] = 0.0
        lasting = np.searchsorted(-sizes, -np.arange(1, sizes[0] + 1), "right")
        for k, n in enumerate(lasting.tolist(), 1):
            here, few = first[:n] + k, back[:k]
            best[here] = (best[here[:, None] - few] + score[here, : len(few)]).max(1)
        end = first + sizes
        now, at = np.arange(len(segments)), end.copy()
        done, other, count = np.zeros(len(segments)), np.full(len(segments), float("-inf")), np.zeros(len(segments), np.int64)
        parts: list[tuple] = []
        while len(now):
            here = at[now]
            ways = best[here[:, None] - back] + score[here]
            # Of equal ones the shortest last piece.
            chosen = ways.argmax(1)
            ways[np.arange(len(now)), chosen] = float("-inf")
            other[now] = np.maximum(other[now], ways.max(1) + done[now])
            done[now] += score[here, chosen]
            parts.append((now, piece[here, chosen]))
            count[now] += 1
            at[now] -= chosen + 1
            now = now[at[now] > first[now]]
        ends = np.cumsum(count)
        ids = np.empty(int(ends[-1]), np.int32)
        for k, (now, own) in enumerate(parts):
            ids[ends[now] - 1 - k] = own
        scores, losses = best[end], np.where(other > float("-inf"), np.maximum(0.0, best[end] - other), float("inf"))
        exact = np.ones(len(segments), bool)
        if (ids < 0).any():
            lists = np.split(ids, ends[:-1])
            for k in np.unique(np.searchsorted(ends, np.flatnonzero(ids < 0), "right")).tolist():
                own, scores[k], loss, exact[k] = self.first_two(segments[k])
                lists[k], count[k], losses[k] = np.array(own, np.int32), len(own), float("inf") if loss is None else loss
            ids, ends = np.concatenate(lists), np.cumsum(count)
        # All decode if all together do, with as many bytes of each segment.
        raw = self.raw
        widths = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        if SPACE in text or " " in text:
            true = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            widths = 1 + (true > 0x7F) + (true > 0x7FF) + (true > 0xFFFF)
        same = np.array_equal(np.add.reduceat(self.raw_size[ids], ends - count), np.add.reduceat(widths, np.cumsum(sizes) - sizes))
        if not same or b"".join([raw[k] for k in ids.tolist()]) != text.encode("utf-8", "surrogatepass"):
            for k, (own, segment) in enumerate(zip(np.split(ids, ends[:-1]), segments, strict=True)):
                exact[k] = b"".join([raw[x] for x in own.tolist()]) == segment.encode("utf-8", "surrogatepass")
        return segments, ids, count, scores, losses, exact

    def encoder(self, n_best: int):
        """A function from a text to (ids as the bytes of 32-bit integers, score, others, exact). others: the next best segmentations as (score, edits), an edit being
        (first id, number of ids, new ids) against the best; exact: all of them decode to the text."""
        many = self.encoder_of_many(n_best)
        return lambda text: next(many([text]))

    def encoder_of_many(self, n_best: int):
        """As encoder(), from a list of texts, whose segments are searched together, to an iterator."""
        find = self.segment.findall
        known = Known()
        search = lru_cache(SEARCHES)(self.search)

        def learn(segments: set[str]) -> None:
            known.forget_if_full()
            places = known.places
            new = sorted([s for s in segments if s not in places], key=len)
            at = 0
            while at < len(new):
                n = max(1, SEARCHED // len(new[at]))
                while n > 1 and len(new[min(at + n, len(new)) - 1]) * n > 2 * SEARCHED:
                    n //= 2
                if len(new[at]) > LONGEST_REMEMBERED:
                    ids, score, loss, exact = self.first_two(new[at])
                    known.add([new[at]], np.array(ids, np.int32), *([x] for x in (len(ids), score, float("inf") if loss is None else loss, exact)))
                    n = 1
                else:
                    known.add(*self.first_twos([x for x in new[at : at + n] if len(x) <= LONGEST_REMEMBERED]))
                    n = sum(len(x) <= LONGEST_REMEMBERED for x in new[at : at + n])
                at += n

        def one(text: str | None, segments: list[str]):
            if not segments:
                return b"", 0.0, [], True
            at = np.fromiter(map(known.places.__getitem__, segments), np.int64, len(segments))
            loss, sizes = known.losses[at], known.sizes[at]
            ids = known.ids_of(at, sizes)
            score = sum(known.scores[at].tolist())
            exact = bool(known.exacts[at].all())
            if n_best < 2:
                return ids.tobytes(), score, [], exact
            # n - 1 segments with the smallest loss of a second segmentation hold all that the n best change.
            few = np.argsort(loss, kind="stable") if len(loss) < n_best else np.nonzero(loss <= np.partition(loss, n_best - 2)[n_best - 2])[0]
            few = sorted(sorted(few[loss[few] < float("inf")].tolist(), key=loss.__getitem__)[: n_best - 1])
            lists: list[tuple[float, tuple]] = [(0.0, ())]
            ends = np.cumsum(sizes)
            starts = {}
            for k in few:
                starts[k] = int(ends[k] - sizes[k])
                first, top = tuple(ids[starts[k] : ends[k]].tolist()), float(known.scores[at[k]])
                own = [(0.0, None)] + [(max(0.0, top - s), new) for s, new in (search if len(segments[k]) <= LONGEST_REMEMBERED else self.search)(segments[k], n_best + 1) if new != first]
                lists = heapq.nsmallest(n_best, ((a + b, (*picks, (k, new)) if new else picks) for a, picks in lists for b, new in own))
            others = []
            for loss, picks in lists[1:]:
                edits = [(starts[k], int(sizes[k]), list(new)) for k, new in picks]
                exact = exact and all(b"".join([self.raw[x] for x in new]) == segments[k].encode("utf-8", "surrogatepass") for k, new in picks)
                others.append((score - loss, edits))
            return ids.tobytes(), score, others, exact

        def many(texts: list[str | None]):
            at = 0
            while at < len(texts):
                n, size = 0, 0
                while at + n < len(texts) and (not n or size + len(texts[at + n] or "") <= TOGETHER):
                    size += len(texts[at + n] or "")
                    n += 1
                lists = [find(" " + text) if text else [] for text in texts[at : at + n]]
                learn(set().union(*lists))
                yield from map(one, texts[at : at + n], lists)
                at += n

        return many


class Known:
    """Segments that have been searched, in arrays: their ids one after the other; and of each the number of ids, the score, the loss and whether it is exact."""

    def __init__(self):
        self.clear()

    def clear(self) -> None:
        self.places: dict[str, int] = {}
        self.ids, self.n_ids = np.empty(1024, np.int32), 0
        self.starts, self.sizes, self.scores, self.losses, self.exacts = (np.empty(1024, kind) for kind in (np.int64, np.int32, np.float64, np.float64, bool))

    def forget_if_full(self) -> None:
        """Searching many again takes little, so all go at once."""
        if len(self.places) >= REMEMBERED or self.n_ids >= REMEMBERED * LONGEST_REMEMBERED // 4:
            self.clear()

    @staticmethod
    def _room(array: np.ndarray, n: int) -> np.ndarray:
        if n <= len(array):
            return array
        out = np.empty(max(n, len(array) * 3 // 2), array.dtype)
        out[: len(array)] = array
        return out

    def add(self, segments: list[str], ids: np.ndarray, sizes, scores, losses, exacts) -> None:
        n = len(self.places)
        end = n + len(segments)
        self.starts, self.sizes, self.scores, self.losses, self.exacts = (self._room(x, end) for x in (self.starts, self.sizes, self.scores, self.losses, self.exacts))
        self.ids = self._room(self.ids, self.n_ids + len(ids))
        self.ids[self.n_ids : self.n_ids + len(ids)] = ids
        self.starts[n:end] = self.n_ids + np.cumsum(sizes) - sizes
        self.sizes[n:end], self.scores[n:end], self.losses[n:end], self.exacts[n:end] = sizes, scores, losses, exacts
        self.n_ids += len(ids)
        self.places.update(zip(segments, range(n, end), strict=True))

    def ids_of(self, at: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        ends = np.cumsum(sizes)
        return self.ids[np.repeat(self.starts[at] - ends + sizes, sizes) + np.arange(ends[-1])]


def applied(ids: list[int], edits) -> list[int]:
    """The ids of another segmentation, from the best one's and its edits."""
    out, at = [], 0
    for first, n, new in edits:
        out += [*ids[at:first], *new]
        at = first + n
    return out + ids[at:]


ENCODED = "ids array<int>, score double, others array<struct<score: double, edits: array<struct<first: int, n: int, ids: array<int>>>>>, exact boolean"
_OTHERS = pa.list_(pa.struct([("score", pa.float64()), ("edits", pa.list_(pa.struct([("first", pa.int32()), ("n", pa.int32()), ("ids", pa.list_(pa.int32()))])))]))


def encode(docs: DataFrame, n_best: int = N_BEST, model_file: str = MODEL_FILE, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Per row of docs: id, the columns of keep, ids (the best segmentation), score, others (the next best ones, as edits), exact.

    Null and empty texts have no ids, score 0, no others and are exact. Fewer than n_best segmentations give fewer others.
    Repeated rows are repeated, null ids stay null, an empty table gives no rows; columns outside keep are ignored, and
    none of keep may bear a name of the result. Texts are encoded whole; nothing is shuffled.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.of_file(model_file))
    slim = docs.select(F.col(id_col), *keep, F.col(text_col).cast("string").alias("_text"))

    def run(batches):
        many = None
        for batch in bounded_batches(batches):
            many = many or shared.value.encoder_of_many(n_best)
            got = list(many(batch.column(batch.num_columns - 1).to_pylist()))
            others = [[{"score": s, "edits": [{"first": a, "n": n, "ids": new} for a, n, new in edits]} for s, edits in g[2]] for g in got]
            ends = np.cumsum([0, *(len(g[0]) // 4 for g in got)], dtype=np.int32)
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(g[0] for g in got), np.int32)))
            columns = [ids, pa.array([g[1] for g in got], pa.float64()), pa.array(others, _OTHERS), pa.array([g[3] for g in got], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *columns], [*batch.schema.names[:-1], "ids", "score", "others", "exact"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[:-1])
    return slim.mapInArrow(run, f"{kept}, {ENCODED}")


def decode(rows: DataFrame, model_file: str = MODEL_FILE, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row: id, text. Null and empty ids give an empty text; ids that the vocabulary doesn't have raise an error."""
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(Pieces.of_file(model_file))

    def run(batches):
        for batch in bounded_batches(batches):
            texts = [shared.value.decode(x or ()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["id", "text"])

    slim = rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids"))
    return slim.mapInArrow(run, "id long, text string").withColumnRenamed("id", id_col)
