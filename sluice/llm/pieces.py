"""SentencePiece encoding and decoding by suffix-array matching.

A batch's texts are cut where no piece can cross: between two characters that no piece of the model has next to
each other. Equal cuts are kept once. Their concatenation is indexed by a suffix
array over as many characters as the longest piece has. Every piece is found in it by binary search; its range of
suffixes gives all its occurrences. These edges (start, end, piece) are sorted by position and relaxed: the
text up to each position has one last piece, and an edge is it if the last piece up to the edge's start and
the edge's piece are a pair that the model's merges would leave as they are. That is the model's own
segmentation, exactly, since merges of neighbours are all that can tell segmentations apart.

Pair test: undo the merges of both pieces at their common border, latest first; if at any time the two
border pieces would have been merged before the merge that came next, the pair is not left as it is.

Cuts met before come from a bounded cache, found by a hash and compared character by character; of a full cache
the older half goes. A cut of more than LONG characters is indexed in windows and relaxed position by position,
so time and memory are linear in its length.

Model files are those of the sentencepiece library: merge models (BPE), identity normalisation, with or
without byte fallback. Others are refused. The file is read by the driver and sent to the executors; its
size does not depend on the corpus.

Edge cases: a null text has a null list; an empty text an empty one; characters outside the vocabulary are
byte pieces (or the unknown piece without byte fallback); repeated texts and rows are encoded alike, each row
giving a row; null and repeated ids are passed on; an empty table gives no rows; other columns are ignored by the
query. Decoding gives the normalised text: the mark stands for a space, and one leading space is dropped if the
model adds one.
"""

from __future__ import annotations

from array import array
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sluice.llm._common import bounded_batches, frugal, frugal_batches, read_table, slices

MARK = "▁"
MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
#: Rows and bytes of text that are worked on at a time.
ROWS, BYTES = 256, 1 << 21
#: A cut of more characters is relaxed alone.
LONG = 192
#: Characters of the cuts in the cache.
CACHED = 3_000_000
_P, _Q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
_END = 1 << 30  # merge order of what is not merged


@dataclass
class PieceModel:
    pieces: list[str]
    kinds: list[str]  # normal, byte, unknown, control
    order: np.ndarray  # of a piece's merge: smaller comes first; -1 for single characters
    left: np.ndarray  # the pieces that a piece is last merged from; itself for single characters
    right: np.ndarray
    pair_keys: np.ndarray  # left * n + right, sorted, of all pairs that merge
    pair_order: np.ndarray  # the order of their merge
    usable: np.ndarray  # pieces that their own text is encoded as
    prefix: bool = True

    @staticmethod
    def load(path: str) -> "PieceModel":
        import sentencepiece as sp
        from sentencepiece import sentencepiece_model_pb2 as pb

        with open(path, "rb") as f:
            raw = f.read()
        proto = pb.ModelProto()
        proto.ParseFromString(raw)
        spec = proto.normalizer_spec
        if proto.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces or not spec.escape_whitespaces or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError(f"{path}: only merge models with identity normalisation are supported")
        m = sp.SentencePieceProcessor(model_proto=raw)
        n = m.get_piece_size()
        kinds = ["byte" if m.is_byte(i) else "unknown" if m.is_unknown(i) else "control" if m.is_control(i) or m.is_unused(i) else "normal" for i in range(n)]
        return PieceModel.build([m.id_to_piece(i) for i in range(n)], kinds, [m.get_score(i) for i in range(n)], prefix=spec.add_dummy_prefix)

    @staticmethod
    def build(pieces: list[str], kinds: list[str], scores: list[float], prefix: bool = True) -> "PieceModel":
        n = len(pieces)
        ids = {p: i for i, (p, k) in enumerate(zip(pieces, kinds, strict=True)) if k == "normal"}
        ranks = {s: r for r, s in enumerate(sorted({scores[i] for i in ids.values()}, reverse=True))}
        order = np.full(n, -1, np.int64)
        left = np.arange(n)
        right = np.arange(n)
        keys, orders = [], []
        usable = np.zeros(n, bool)
        for p, i in ids.items():
            if len(p) == 1:
                usable[i] = True
                continue
            order[i] = ranks[scores[i]]
            for k in range(1, len(p)):
                a, b = ids.get(p[:k]), ids.get(p[k:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    orders.append(order[i])
        for p, i in ids.items():
            if len(p) > 1:
                last = None
                parts = list(p)
                while len(parts) > 1:  # the plain merges of a piece's own text, at most its length long
                    best = None
                    for k in range(len(parts) - 1):
                        j = ids.get(parts[k] + parts[k + 1])
                        if j is not None and (best is None or order[j] < best[0]):
                            best = (order[j], k)
                    if best is None:
                        break
                    k = best[1]
                    last = (parts[k], parts[k + 1])
                    parts[k : k + 2] = [parts[k] + parts[k + 1]]
                if len(parts) == 1:
                    usable[i] = last[0] in ids and last[1] in ids
                    if usable[i]:
                        left[i], right[i] = ids[last[0]], ids[last[1]]
        sort = np.argsort(np.array(keys, np.int64), kind="stable")
        return PieceModel(pieces, kinds, order, left, right, np.array(keys, np.int64)[sort], np.array(orders, np.int64)[sort], usable, prefix)

    # what follows is derived once in each process
    def tables(self):
        if not hasattr(self, "_tables"):
            used = [i for i in np.flatnonzero(self.usable) if self.kinds[i] == "normal"]
            used.sort(key=lambda i: self.pieces[i])  # as suffixes are, so that searches follow each other closely
            bytes_of = {int(p[1:-1], 16): i for i, p in enumerate(self.pieces) if self.kinds[i] == "byte"}
            unk = next((i for i, k in enumerate(self.kinds) if k == "unknown"), 0)
            self._tables = (np.array(used), [self.pieces[i] for i in used], np.array([len(self.pieces[i]) for i in used], np.int32), max((len(self.pieces[i]) for i in used), default=1), bytes_of, unk)
        return self._tables

    def joined(self) -> tuple[np.ndarray, np.ndarray]:
        """A class for each code point, and which two classes some piece has next to each other."""
        if not hasattr(self, "_joined"):
            normal = [p for p, k in zip(self.pieces, self.kinds, strict=True) if k == "normal"]
            chars = sorted({c for p in normal if len(p) > 1 for c in p})
            number = {c: i for i, c in enumerate(chars, 2)}
            classes = np.zeros(0x110000, np.uint16)  # 0: in no piece; 1: a piece of its own only
            classes[[ord(p) for p in normal if len(p) == 1]] = 1
            classes[[ord(c) for c in chars]] = np.arange(2, len(chars) + 2)
            table = np.zeros((len(chars) + 2, len(chars) + 2), bool)
            for p in normal:
                for a, b in zip(p, p[1:], strict=False):
                    table[number[a], number[b]] = True
            # without byte fallback neighbouring unknown characters are one piece; a character that is in longer pieces only may be unknown
            if "byte" not in self.kinds:
                odd = [0, *(number[c] for c in chars if c not in normal)]
                table[np.ix_(odd, odd)] = True
            self._joined = classes, table
        return self._joined

    def __reduce_ex__(self, protocol):
        names = self.__dataclass_fields__
        return (_restore, ({k: v for k, v in self.__dict__.items() if k in names},))

    def stays(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the merges leave the neighbours a, b as they are (ids of usable pieces)."""
        ok = np.ones(len(a), bool)
        a, b = a.astype(np.int64), b.astype(np.int64)
        live = np.arange(len(a))
        limit = np.full(len(a), _END, np.int64)
        after = np.zeros(len(a), bool)  # whether the merge at the limit is to the right of the border
        n, keys = len(self.pieces), self.pair_keys
        while len(live):
            k = a * n + b
            at = np.minimum(np.searchsorted(keys, k), len(keys) - 1) if len(keys) else np.zeros(len(k), np.int64)
            merges = (keys[at] == k) if len(keys) else np.zeros(len(k), bool)
            o = self.pair_order[at] if len(keys) else np.zeros(len(k), np.int64)
            crossed = merges & ((o < limit) | ((o == limit) & after))  # of equal merges the leftmost is first
            ok[live[crossed]] = False
            oa, ob = self.order[a], self.order[b]
            go = ~crossed & ((oa >= 0) | (ob >= 0))
            live, a, b, oa, ob = live[go], a[go], b[go], oa[go], ob[go]
            of_a = oa > ob
            limit = np.where(of_a, oa, ob)
            after = ~of_a
            a, b = np.where(of_a, self.right[a], a), np.where(of_a, b, self.left[b])
        return ok

    def stays_one(self, a: int, b: int) -> bool:
        """``stays`` for one pair."""
        if not hasattr(self, "_merges"):
            self._merges = dict(zip(self.pair_keys.tolist(), self.pair_order.tolist(), strict=True)), self.order.tolist(), self.left.tolist(), self.right.tolist()
        merges, order, left, right = self._merges
        limit, after, n = _END, False, len(self.pieces)
        while True:
            o = merges.get(a * n + b)
            if o is not None and (o < limit or (o == limit and after)):
                return False
            oa, ob = order[a], order[b]
            if oa < 0 and ob < 0:
                return True
            if oa > ob:
                limit, after, a = oa, False, right[a]
            else:
                limit, after, b = ob, True, left[b]

    def edges(self, codes: np.ndarray, left_over: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, piece, length) of every occurrence of a piece; left_over: characters from each position to its part's end."""
        used, texts, lengths, longest, _, _ = self.tables()
        suffixes, keys, pack = suffix_array(codes, left_over, min(longest, int(left_over.max())))
        found, lo, hi = piece_ranges(texts, keys, pack)
        starts = suffixes[_ranges(lo, hi)].astype(np.int32)
        piece = np.repeat(used[found].astype(np.int32), hi - lo)
        length = np.repeat(lengths[found], hi - lo)
        # characters that are no piece: an edge of their own, numbered after the pieces, never merged
        known = np.zeros(len(codes), bool)
        known[starts[length == 1]] = True
        odd = np.flatnonzero(~known)
        return np.r_[starts, odd.astype(np.int32)], np.r_[piece, np.full(len(odd), len(self.pieces), np.int32)], np.r_[length, np.ones(len(odd), np.int32)]

    def segment(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all parts and where each part's begin (one more at the end), by suffix array, edges and relaxation over their concatenation."""
        n_ids = len(self.pieces)
        codes = _code_points("".join(parts))
        size = np.array([len(p) for p in parts], np.int64)
        begin = np.r_[0, np.cumsum(size)]
        n = len(codes)
        if not n:
            return np.zeros(0, np.int32), np.zeros(len(parts) + 1, np.int64)
        owner = np.repeat(np.arange(len(parts)), size)
        local = np.arange(n) - begin[:-1][owner]
        left_over = size[owner] - local
        starts, piece, length = self.edges(codes, left_over)
        step = local[starts].astype(np.int32) + length
        order = np.argsort(step.astype(np.uint16) if size.max() < 1 << 16 else step, kind="stable")
        starts, piece, length, step = starts[order], piece[order], length[order], step[order]
        last = np.full(n + 1, -1, np.int64)  # piece that ends before each position, counted within its part
        came = np.zeros(n + 1, np.int64)
        ends = starts + length
        bounds = np.searchsorted(step, np.arange(1, int(size.max()) + 2))
        at_start = local == 0
        for t in range(len(bounds) - 1):
            i, j = bounds[t], bounds[t + 1]
            if i == j:
                continue
            s, p, e = starts[i:j], piece[i:j], ends[i:j]
            first = at_start[s]
            before = np.where(first, n_ids, last[s - 1])  # last[k]: of the text up to and with position k
            free = (before == n_ids) | (p == n_ids)
            good = free.copy()
            test = np.flatnonzero(~free)
            good[test] = self.stays(before[test], p[test])
            last[e[good] - 1] = p[good]
            came[e[good] - 1] = s[good]
        # back from each part's end along the last pieces, all parts at a time
        at = np.where(size > 0, begin[1:] - 1, -1)
        who = np.flatnonzero(size > 0)
        owners, ids, spots = [], [], []
        pos = at[who]
        while len(who):
            owners.append(who)
            ids.append(last[pos])
            spots.append(came[pos])
            nxt = came[pos] - 1
            go = nxt >= begin[who]
            who, pos = who[go], nxt[go]
        owners, ids, spots = np.concatenate(owners), np.concatenate(ids), np.concatenate(spots)
        order = np.argsort(spots, kind="stable")
        return self._spelled(codes, owners[order], ids[order], spots[order], len(parts))

    def segment_long(self, part: str, window: int = 1 << 16) -> np.ndarray:
        """Piece ids of one long part: its edges window by window, relaxed position by position."""
        codes, n_ids, longest = _code_points(part), len(self.pieces), self.tables()[3]
        n = len(codes)
        last, came, memo = array("i", bytes(4 * n)), array("i", bytes(4 * n)), {}
        for a in range(0, n, window):
            b, back = min(n, a + window), max(0, a - longest)  # edges that end in (a, b]
            starts, piece, length = self.edges(codes[back:b], np.arange(b - back, 0, -1))
            starts = starts + back
            ends = starts + length
            inside = np.flatnonzero(ends > a)
            inside = inside[np.argsort(ends[inside], kind="stable")]
            for s, p, e in zip(starts[inside].tolist(), piece[inside].tolist(), ends[inside].tolist(), strict=True):
                before = last[s - 1] if s else n_ids
                if before != n_ids and p != n_ids:
                    k = before * n_ids + p
                    ok = memo.get(k)
                    if ok is None:
                        ok = memo[k] = self.stays_one(before, p)
                    if not ok:
                        continue
                last[e - 1] = p
                came[e - 1] = s
            if len(memo) > 1_000_000:
                memo.clear()
        ids, spots, at = array("i"), array("i"), n - 1
        while at >= 0:
            ids.append(last[at])
            spots.append(came[at])
            at = came[at] - 1
        ids, spots = (np.array(x, np.int64)[::-1] for x in (ids, spots))
        return self._spelled(codes, np.zeros(len(ids), np.int64), ids, spots, 1)[0]

    def _spelled(self, codes, owners, ids, spots, parts: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids in order and where each part's begin; characters that are no piece become byte pieces or unknown ones."""
        _, _, _, _, bytes_of, unk = self.tables()
        n_ids = len(self.pieces)
        odd = np.flatnonzero(ids == n_ids)
        if len(odd):
            forms = [[bytes_of[b] for b in chr(c).encode("utf-8", "replace")] if bytes_of else [unk] for c in codes[spots[odd]].tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(f) for f in forms]
            ids, owners, was_odd = np.repeat(ids, times), np.repeat(owners, times), np.repeat(ids == n_ids, times)
            ids[was_odd] = [i for f in forms for i in f]
            if not bytes_of:  # neighbouring unknown characters are one unknown piece
                again = was_odd & np.r_[False, was_odd[:-1] & (owners[1:] == owners[:-1])]
                ids, owners = ids[~again], owners[~again]
        return ids.astype(np.int32), np.searchsorted(owners, np.arange(parts + 1))

    def encode_flat(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Piece ids of all texts, and where each text's begin (one more at the end); null texts have none."""
        lead = MARK if self.prefix else ""
        marked = [lead + t.replace(" ", MARK) if t else "" for t in texts]
        rows = np.r_[0, np.cumsum([len(t) for t in marked])]
        joined = "".join(marked)
        del marked
        codes = _code_points(joined)
        if not len(codes):
            return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
        classes, table = self.joined()
        kind = classes[codes]
        fresh = np.r_[True, ~table[kind[:-1], kind[1:]]]
        fresh[rows[:-1][rows[:-1] < len(codes)]] = True
        start = np.flatnonzero(fresh)
        del kind, fresh
        size = np.diff(np.r_[start, len(codes)])
        # of each cut a hash: a sum of mixed (character, place) words
        v = (codes.astype(np.uint64) | ((np.arange(len(codes)) - np.repeat(start, size)).astype(np.uint64) << np.uint64(24))) * _P
        v ^= v >> np.uint64(29)
        v *= _Q
        v ^= v >> np.uint64(32)
        hashes, spot, which = np.unique(np.add.reduceat(v, start), return_index=True, return_inverse=True)
        del v
        slot = self._slots(hashes, start[spot], start[spot] + size[spot], joined)[which]
        # equal hashes of different cuts: those that differ from the cached text are segmented for themselves
        other = self.chars[slot] != size
        if not other.any():
            other = ~np.logical_and.reduceat(self.text[_ranges(self.text_at[slot], self.text_at[slot] + size)] == codes, start)
        if other.any():
            at = np.flatnonzero(other)
            slot[at] = self._add([joined[start[i] : start[i] + size[i]] for i in at])
        n = self.size[slot]
        ids = self.flat[_ranges(self.first[slot], self.first[slot] + n)]
        upto = np.r_[0, np.cumsum(n)]
        return ids, upto[np.searchsorted(start, rows)]

    def _slots(self, hashes: np.ndarray, begin: np.ndarray, end: np.ndarray, joined: str) -> np.ndarray:
        """The cache slot of each hash (ascending, no two equal); new ones are segmented. begin, end: where in `joined` one has its text."""
        if not hasattr(self, "flat"):
            self.flat, self.first, self.size = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.text, self.text_at, self.chars = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
            self.known, self.slot_of = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        if len(self.text) > CACHED:  # the older half goes
            k = len(self.size) // 2
            a, b = int(self.first[k]), int(self.text_at[k])
            self.flat, self.first, self.size = self.flat[a:].copy(), self.first[k:] - a, self.size[k:].copy()
            self.text, self.text_at, self.chars = self.text[b:].copy(), self.text_at[k:] - b, self.chars[k:].copy()
            stay = self.slot_of >= k
            self.known, self.slot_of = self.known[stay], self.slot_of[stay] - k
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        have = self.known[at] == hashes if len(self.known) else np.zeros(len(hashes), bool)
        slot = np.where(have, self.slot_of[at], -1) if len(self.known) else np.full(len(hashes), -1)
        new = np.flatnonzero(~have)
        if len(new):
            slot[new] = self._add([joined[a:b] for a, b in zip(begin[new].tolist(), end[new].tolist(), strict=True)])
            known, slots = np.r_[self.known, hashes[new]], np.r_[self.slot_of, slot[new]]
            order = np.argsort(known, kind="stable")
            self.known, self.slot_of = known[order], slots[order]
        return slot

    def _add(self, cuts: list[str], part_chars: int = 1 << 17) -> np.ndarray:
        """Segments cuts into new slots of the cache."""
        n0, flat, counts, group, chars = len(self.size), [self.flat], [], [], 0
        short = sorted((i for i, c in enumerate(cuts) if len(c) <= LONG), key=lambda i: len(cuts[i]))  # of like lengths together
        slots = np.zeros(len(cuts), np.int64)
        done: list[int] = []
        for k, i in enumerate(short):
            group.append(cuts[i])
            chars += len(cuts[i])
            if chars >= part_chars or k == len(short) - 1:
                ids, at = self.segment(group)
                flat.append(ids)
                counts.append(np.diff(at))
                group, chars = [], 0
        done += short
        for i, c in enumerate(cuts):
            if len(c) > LONG:
                flat.append(self.segment_long(c))
                counts.append(np.array([len(flat[-1])]))
                done.append(i)
        counts = np.concatenate(counts) if counts else np.zeros(0, np.int64)
        slots[done] = np.arange(n0, n0 + len(cuts))
        size = np.array([len(cuts[i]) for i in done], np.int64)
        self.first = np.r_[self.first, len(self.flat) + np.r_[0, np.cumsum(counts)[:-1]]] if len(cuts) else self.first
        self.size = np.r_[self.size, counts]
        self.flat = np.concatenate(flat)
        self.text_at = np.r_[self.text_at, len(self.text) + np.r_[0, np.cumsum(size)[:-1]]] if len(cuts) else self.text_at
        self.chars = np.r_[self.chars, size]
        self.text = np.r_[self.text, _code_points("".join(cuts[i] for i in done))]
        return slots

    def encode(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """Piece ids of each text."""
        ids, at = self.encode_flat(texts)
        return [None if t is None else ids[a:b] for t, a, b in zip(texts, at, at[1:], strict=False)]

    def decode_flat(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of the lists of ids that begin at `at`: byte pieces joined as UTF-8, marks as spaces, the added space dropped."""
        if not hasattr(self, "_bytes"):
            form = [bytes([int(p[1:-1], 16)]) if k == "byte" else b"" if k == "control" else " ⁇ ".encode() if k == "unknown" else p.replace(MARK, " ").encode("utf-8", "surrogatepass") for p, k in zip(self.pieces, self.kinds, strict=True)]
            self._bytes = pa.array(form, pa.large_binary())
        spelled = self._bytes.take(pa.array(ids))
        upto = np.frombuffer(spelled.buffers()[1], np.int64, len(ids) + 1) if len(ids) else np.zeros(1, np.int64)
        raw = memoryview(spelled.buffers()[2]) if len(ids) and spelled.buffers()[2] is not None else memoryview(b"")
        texts = [str(raw[a:b], "utf-8", "replace") for a, b in zip(upto[at[:-1]].tolist(), upto[at[1:]].tolist(), strict=True)]
        return [t[1:] if t.startswith(" ") else t for t in texts] if self.prefix else texts

    def decode(self, ids: np.ndarray | list[int] | None) -> str | None:
        """The text of a list of ids."""
        return None if ids is None else self.decode_flat(np.asarray(ids, np.int32), np.array([0, len(ids)]))[0]


def _code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _restore(state: dict) -> PieceModel:
    m = PieceModel.__new__(PieceModel)
    m.__dict__.update(state)
    return m


def _ranges(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """lo[0], lo[0]+1, ... hi[0]-1, lo[1], ..."""
    size = hi - lo
    total = int(size.sum())
    if not total:
        return np.zeros(0, np.int64)
    return np.arange(total) + np.repeat(lo - np.r_[0, np.cumsum(size)[:-1]], size)


def suffix_array(codes: np.ndarray, left_over: np.ndarray, depth: int):
    """Suffixes in the order of their first `depth` characters (cut at their part's end), the words by which
    they were sorted, and how to pack a text into such words."""
    alphabet = np.unique(codes)
    bits = max(1, int(len(alphabet)).bit_length())
    per = 63 // bits
    rank = (np.searchsorted(alphabet, codes) + 1).astype(np.int64)  # 0: past the end
    n, words = len(codes), -(-depth // per)
    padded = np.r_[rank, np.zeros(words * per, np.int64)]
    keys = []
    for w in range(words):
        k = np.zeros(n, np.int64)
        for c in range(w * per, (w + 1) * per):
            inside = left_over > c
            k = (k << bits) | np.where(inside, padded[c : c + n], 0)
        keys.append(k)
    order = np.argsort(keys[0], kind="stable")
    for w in range(1, words):  # refine: groups equal so far become ranks, and the next word sorts within them
        head = keys[0] if w == 1 else group
        sorted_head = head[order]
        new = np.r_[True, sorted_head[1:] != sorted_head[:-1]]
        group_sorted = np.cumsum(new)
        within = np.lexsort((keys[w][order], group_sorted)) if group_sorted[-1] < n else np.arange(n)
        order = order[within]
        group_sorted = group_sorted[within]
        k = keys[w][order]
        fresh = np.r_[True, (group_sorted[1:] != group_sorted[:-1]) | (k[1:] != k[:-1])]
        group = np.empty(n, np.int64)
        group[order] = np.cumsum(fresh)
    sorted_keys = [k[order] for k in keys]
    return order, sorted_keys, (alphabet, bits, per, words)


def piece_ranges(texts: list[str], keys: list[np.ndarray], pack) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For the pieces (in the order of their code points) that occur: their index, and the first and past-the-last suffix that begins with them."""
    alphabet, bits, per, words = pack
    size = np.array([len(t) for t in texts], np.int64)
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    at = np.minimum(np.searchsorted(alphabet, codes), len(alphabet) - 1)
    known = alphabet[at] == codes
    begin = np.r_[0, np.cumsum(size)[:-1]]
    whole = np.minimum.reduceat(known.astype(np.int8), begin).astype(bool) if len(texts) else np.zeros(0, bool)
    index = np.flatnonzero(whole)
    size, begin = size[index], begin[index]
    top = (1 << bits) - 1
    lows, highs = [], []
    for w in range(words):
        lo, hi = np.zeros(len(index), np.int64), np.zeros(len(index), np.int64)
        for c in range(w * per, (w + 1) * per):
            inside = size > c
            r = np.where(inside, at[np.minimum(begin + c, len(at) - 1)] + 1, 0)
            lo = (lo << bits) | r
            hi = (hi << bits) | np.where(inside, r, top)
        lows.append(lo)
        highs.append(hi)
    a, b = _bisect(keys, lows, False), _bisect(keys, highs, True)
    hit = b > a
    return index[hit], a[hit], b[hit]


def _bisect(keys: list[np.ndarray], want: list[np.ndarray], after: bool) -> np.ndarray:
    """Where each wanted tuple of words belongs among the sorted tuples; after: past its equals."""
    lo = np.searchsorted(keys[0], want[0], "left")
    hi = np.searchsorted(keys[0], want[0], "right")
    for k, w in zip(keys[1:], want[1:], strict=True):
        # within [lo, hi) the earlier words are equal and this one is sorted
        out = []
        for side in ("left", "right"):
            a, b = lo.copy(), hi.copy()
            while (open_ := a < b).any():
                mid = (a + b) >> 1
                v = k[np.minimum(mid, len(k) - 1)]
                up = open_ & ((v < w) if side == "left" else (v <= w))
                down = open_ & ~up
                a[up] = mid[up] + 1
                b[down] = mid[down]
            out.append(a)
        lo, hi = out
    return hi if after else lo


def encode(spark: SparkSession, model: PieceModel, text):
    """A list column of piece ids of a text column."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("array<int>")
    @frugal
    def run(col: pa.Array) -> pa.Array:
        parts = [_lists(t, *shared.value.encode_flat(t)) for t in (col.slice(i, n).to_pylist() for i, n in slices(col, ROWS, BYTES))]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.list_(pa.int32()))

    return run(text)


def decode(spark: SparkSession, model: PieceModel, ids):
    """A text column of a list column of piece ids."""
    shared = spark.sparkContext.broadcast(model)

    @F.arrow_udf("string")
    @frugal
    def run(col: pa.Array) -> pa.Array:
        return pa.array([shared.value.decode(v.values.to_numpy(zero_copy_only=False) if v.is_valid else None) for v in col], pa.string())

    return run(ids)


def _lists(texts: list[str | None], ids: np.ndarray, at: np.ndarray) -> pa.Array:
    mask = pa.array([t is None for t in texts], pa.bool_())
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids, pa.int32()), mask=mask)


def encoded(spark: SparkSession, docs: DataFrame, model_file: str = MODEL_FILE) -> DataFrame:
    """doc_id, ids, n_ids, and whether decoding gives the text back.

    A text that holds the mark itself or code points that UTF-8 lacks comes back with spaces or signs instead.
    """
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(PieceModel.load(model_file))

    def run(batches):
        """In slices, so that no more than a slice's lists are held beside a batch."""
        model = shared.value
        for batch in batches:
            for i, k in slices(batch.column("text"), ROWS, BYTES):
                part = batch.slice(i, k)
                texts = part.column("text").to_pylist()
                ids, at = model.encode_flat(texts)
                same = pa.array([t is None or t == back for t, back in zip(texts, model.decode_flat(ids, at), strict=True)], pa.bool_())
                n = pa.array(np.diff(at), pa.int64(), mask=np.array([t is None for t in texts], bool))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), _lists(texts, ids, at), n, same], ["doc_id", "ids", "n_ids", "round_trip"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(frugal_batches(run), f"doc_id {kind}, ids array<int>, n_ids bigint, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoded(spark, read_table(spark, sf_dir, "documents"))
