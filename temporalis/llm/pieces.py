"""N-best segmentation over a SentencePiece vocabulary, and decoding.

The lattice of a text has a node at each byte and an edge for each piece of the vocabulary
that matches there, with the piece's score; a code point that no single piece covers gets
one edge, ``UNKNOWN`` below the least score, that stands for its byte pieces. Spaces are
written as the model writes them, with one put before the text. The public model's scores
are merge ranks; here they are taken as they stand, as the log-scores of a unigram lattice.

No piece holds a space after another character, so a text's lattice is a chain of cells: a
run of spaces and what follows it. In each distinct cell forward Viterbi gives the best
score of every prefix, which is an exact heuristic for the A* search that walks back from
the end: hypotheses leave the agenda in the order of their final scores, so no more than
the wanted number have to stay in it. All cells of a batch search side by side. The N best
of a text are the N smallest sums of its cells' regrets; only the N - 1 cells of smallest
regret can take part. Cells of more than ``LONG`` bytes are searched one at a time, with the
same rules and a heap.

Ties go to the path found first: shorter last pieces first. Nulls: a null text is empty: it has one
segmentation without pieces. Every row is returned, repeated ones too; a null doc_id stays
null. Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator
from itertools import product
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .chunks import SPACE, ChunkCodes, chunk_bytes, cut_chunks, ragged_take
from .shared import lean, ship
from .textcore import segment_sums, slices

N_BEST = 3
LONG = 96
UNKNOWN = 10.0
SLICE = 4 << 20
#: Cells that a worker remembers; each takes about 80 bytes.
CELLS = 400_000
SIDE_BY_SIDE = 1 << 13
_BAR = "▁"
_LEAD = np.ones(256, dtype=bool)
_LEAD[128:192] = False
_PROBE = 0x9E3779B97F4A7C15


class Vocabulary(NamedTuple):
    """Bytes and score of each id (spaces for bars), byte pieces, and a trie in a hash table."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    normal: np.ndarray
    keys: np.ndarray
    values: np.ndarray
    ends: np.ndarray
    unknown: float


_loaded: dict[str, Vocabulary] = {}


def load_vocabulary(path: str) -> Vocabulary:
    """Read a model file; one a worker process and path."""
    if path in _loaded:
        return _loaded[path]
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    n = model.get_piece_size()
    pieces, scores = [], np.array([model.get_score(i) for i in range(n)])
    byte_ids, normal = np.full(256, -1), np.zeros(n, dtype=bool)
    for i in range(n):
        word = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(word[3:5], 16)] = i
            pieces.append(bytes([int(word[3:5], 16)]))
        elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            pieces.append(b"")
        else:
            normal[i] = True
            if _BAR in word.lstrip(_BAR):
                raise ValueError(f"{path}: {word} holds a space after another character, so texts can't be cut into cells")
            pieces.append(word.replace(_BAR, " ").encode())
    _loaded[path] = build_vocabulary(pieces, scores, byte_ids, normal)
    return _loaded[path]


def build_vocabulary(pieces: list[bytes], scores: np.ndarray, byte_ids: np.ndarray, normal: np.ndarray) -> Vocabulary:
    step: dict[int, int] = {}
    ends = [-1]
    for i in np.flatnonzero(normal).tolist():
        state = 0
        for c in pieces[i]:
            key = (state << 8) | c
            if key not in step:
                step[key] = len(ends)
                ends.append(-1)
            state = step[key]
        ends[state] = i
    size = 1 << max(10, (len(step) * 8).bit_length())
    keys, values = np.full(size, -1, dtype=np.int64), np.zeros(size, dtype=np.int32)
    shift, mask = 64 - (size.bit_length() - 1), (1 << 64) - 1
    for key, state in step.items():
        at = (key * _PROBE & mask) >> shift
        while keys[at] >= 0:
            at = (at + 1) & (size - 1)
        keys[at], values[at] = key, state
    usual = scores[normal & (scores > -1e8)]
    return Vocabulary(pieces, scores, byte_ids, normal, keys, values, np.array(ends), float(usual.min() if len(usual) else 0) - UNKNOWN)


def _step(v: Vocabulary, key: np.ndarray) -> np.ndarray:
    """The state that each (state, byte) leads to, or -1."""
    size = len(v.keys)
    with np.errstate(over="ignore"):
        at = ((key.astype(np.uint64) * np.uint64(_PROBE)) >> np.uint64(64 - (size.bit_length() - 1))).astype(np.int64)
    held = v.keys[at]
    out = np.where(held == key, v.values[at], -1)
    left = np.flatnonzero((held != key) & (held >= 0))
    while len(left):
        at[left] = (at[left] + 1) & (size - 1)
        held = v.keys[at[left]]
        hit = held == key[left]
        out[left[hit]] = v.values[at[left[hit]]]
        left = left[~hit & (held >= 0)]
    return out


def lattice(v: Vocabulary, buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Edges (start, end, id, score) of all cells, by end, then start from right to left; id -1: unknown."""
    lead = np.flatnonzero(_LEAD[buf])
    stop = np.repeat(offs[1:], np.diff(offs))[lead] if len(buf) else lead
    after = np.append(lead[1:], len(buf))
    start, end, piece = [], [], []
    at, state, depth = np.arange(len(lead)), np.zeros(len(lead), dtype=np.int64), 0
    single = np.zeros(len(lead), dtype=bool)
    while len(at):
        state = _step(v, (state << 8) | buf[lead[at] + depth])
        depth += 1
        live = state >= 0
        at, state = at[live], state[live]
        ids = v.ends[state]
        hit = np.flatnonzero(ids >= 0)
        start.append(lead[at[hit]])
        end.append(lead[at[hit]] + depth)
        piece.append(ids[hit])
        single[at[hit[lead[at[hit]] + depth == after[at[hit]]]]] = True
        live = lead[at] + depth < stop[at]
        at, state = at[live], state[live]
    odd = np.flatnonzero(~single)
    start, end = np.concatenate([*start, lead[odd]]), np.concatenate([*end, after[odd]])
    piece = np.concatenate([*piece, np.full(len(odd), -1)])
    order = np.lexsort((-start, end))
    start, end, piece = start[order], end[order], piece[order]
    return start, end, piece, np.where(piece >= 0, v.scores[piece], v.unknown)


def _forward(cell_offs, start, end, score):
    """Best score from a cell's begin to each byte place; places of cell c begin at offs[c] + c."""
    n_cells = len(cell_offs) - 1
    cell = np.searchsorted(cell_offs, start, side="right") - 1
    s, e = start + cell, end + cell
    best = np.full(int(cell_offs[-1]) + n_cells, -np.inf)
    best[cell_offs[:-1] + np.arange(n_cells)] = 0.0
    depth = end - cell_offs[cell]
    order = np.argsort(depth, kind="stable")
    cuts = np.searchsorted(depth[order], np.arange(int(depth.max(initial=0)) + 2))
    for d in range(1, len(cuts) - 1):
        own = order[cuts[d] : cuts[d + 1]]
        if len(own):
            to = e[own]
            first = np.flatnonzero(np.diff(to, prepend=-1))
            best[to[first]] = np.maximum.reduceat(best[s[own]] + score[own], first)
    return cell, s, e, best


def search_cells(v: Vocabulary, buf: np.ndarray, offs: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(flat ids, sizes, scores) of the n best segmentations of each cell, best first; -inf: there is none."""
    cells = len(offs) - 1
    start, end, piece, score = lattice(v, buf, offs)
    cell, s, e, best = _forward(offs, start, end, score)
    first_edge = np.searchsorted(e, np.arange(len(best) + 1))
    root = offs[:-1] + np.arange(cells)
    # an agenda entry: cell, place, score of what follows it, node; nodes: (edge, next node)
    places = offs[1:] + np.arange(cells)
    a_cell, a_place, a_tail, a_node = np.arange(cells), places, np.zeros(cells), np.full(cells, -1)
    edges, nexts, n_nodes = [], [], 0
    found = np.zeros(cells, dtype=np.int64)
    out_score, out_node = np.full((cells, n), -np.inf), np.full((cells, n), -1)
    while len(a_cell):
        top = np.ones(len(a_cell), dtype=bool)
        top[1:] = a_cell[1:] != a_cell[:-1]
        at = np.flatnonzero(top)
        done = at[a_place[at] == root[a_cell[at]]]
        c = a_cell[done]
        out_score[c, found[c]], out_node[c, found[c]] = a_tail[done], a_node[done]
        found[c] += 1
        go = at[a_place[at] != root[a_cell[at]]]
        ways = first_edge[a_place[go] + 1] - first_edge[a_place[go]]
        k = np.repeat(go, ways)
        edge = np.arange(len(k)) + np.repeat(first_edge[a_place[go]] - (np.cumsum(ways) - ways), ways)
        alive = best[s[edge]] > -np.inf
        k, edge = k[alive], edge[alive]
        edges.append(edge)
        nexts.append(a_node[k])
        node = n_nodes + np.arange(len(edge))
        n_nodes += len(edge)
        rest = ~top
        x_cell = np.concatenate([a_cell[rest], a_cell[k]])
        x_place = np.concatenate([a_place[rest], s[edge]])
        x_tail = np.concatenate([a_tail[rest], a_tail[k] + score[edge]])
        x_node = np.concatenate([a_node[rest], node])
        want = n - found
        order = np.lexsort((-(best[x_place] + x_tail), x_cell))
        x_cell = x_cell[order]
        rank = np.arange(len(order)) - np.searchsorted(x_cell, x_cell, side="left")
        keep = order[rank < want[x_cell]]
        a_cell, a_place, a_tail, a_node = x_cell[rank < want[x_cell]], x_place[keep], x_tail[keep], x_node[keep]
    edges = np.concatenate([*edges, np.zeros(0, dtype=np.int64)])
    nexts = np.concatenate([*nexts, np.zeros(0, dtype=np.int64)])
    # follow all paths from their first piece on
    path = np.flatnonzero(out_score.ravel() > -np.inf)
    node = out_node.ravel()[path]
    owner, taken = [], []
    while len(path):
        live = node >= 0
        path, node = path[live], node[live]
        owner.append(path)
        taken.append(edges[node])
        node = nexts[node]
    owner, taken = np.concatenate([*owner, np.zeros(0, np.int64)]), np.concatenate([*taken, np.zeros(0, np.int64)])
    order = np.argsort(owner, kind="stable")
    owner, taken = owner[order], taken[order]
    return *_expand(v, buf, start[taken], end[taken], piece[taken], owner, cells * n), out_score


def _expand(v, buf, start, end, piece, owner, n):
    """Ids of paths, unknown code points as their bytes, and the number of ids of each path."""
    size = np.where(piece >= 0, 1, end - start)
    row = np.repeat(np.arange(len(piece)), size)
    nth = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    flat = np.where(piece[row] >= 0, piece[row], v.byte_ids[buf[np.minimum(start[row] + nth, max(len(buf) - 1, 0))]]) if len(row) else np.zeros(0, np.int64)
    return flat, np.bincount(owner[row], minlength=n)


def search_long(v: Vocabulary, cell: bytes, n: int) -> tuple[list[list[int]], list[float]]:
    """The same for one cell of any length, with a heap as agenda."""
    buf = np.frombuffer(cell, dtype=np.uint8)
    start, end, piece, score = lattice(v, buf, np.array([0, len(buf)]))
    first = np.searchsorted(end, np.arange(len(buf) + 2)).tolist()
    starts, scores = start.tolist(), score.tolist()
    best = [-np.inf] * (len(buf) + 1)
    best[0] = 0.0
    for p in range(1, len(buf) + 1):
        best[p] = max((best[starts[k]] + scores[k] for k in range(first[p], first[p + 1])), default=-np.inf)
    agenda, born = [(-best[len(buf)], 0, len(buf), 0.0, None)], 0
    paths, totals = [], []
    while agenda and len(paths) < n:
        _, _, place, tail, path = heapq.heappop(agenda)
        if place == 0:
            ids = []
            while path:
                k, path = path
                ids += [int(piece[k])] if piece[k] >= 0 else [int(v.byte_ids[c]) for c in cell[starts[k] : end[k]]]
            paths.append(ids)
            totals.append(tail)
            continue
        for k in range(first[place], first[place + 1]):
            if best[starts[k]] > -np.inf:
                born += 1
                heapq.heappush(agenda, (-(best[starts[k]] + scores[k] + tail), born, starts[k], tail + scores[k], (k, path)))
        if len(agenda) > 64 * n:
            agenda = heapq.nsmallest(n, agenda)  # exact heuristics: no other can be among the n best
            heapq.heapify(agenda)
    return paths, totals


def cell_codes(path: str, n: int) -> tuple[Vocabulary, ChunkCodes]:
    """The codes of a cell: for each of n ranks, size, score (as two 32-bit halves), then ids."""
    v = load_vocabulary(path)
    known = f"{path}|{n}"
    if known not in _coders:
        _coders[known] = ChunkCodes(lambda cells: _encode(v, cells, n), np.uint32, CELLS)
    return v, _coders[known]


_coders: dict[str, ChunkCodes] = {}


def _encode(v: Vocabulary, cells: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    buf, offs = chunk_bytes(cells)
    width = np.diff(offs)
    short = np.flatnonzero(width <= LONG)
    sizes, scores = np.zeros((len(width), n), dtype=np.int64), np.full((len(width), n), -np.inf)
    parts, owners = [], []
    for i in range(0, len(short), SIDE_BY_SIDE):
        own = short[i : i + SIDE_BY_SIDE]
        b, size = ragged_take(buf, offs, own)
        flat, count, total = search_cells(v, b, np.concatenate([[0], np.cumsum(size)]), n)
        sizes[own], scores[own] = count.reshape(-1, n), total
        parts.append(flat)
        owners.append(np.repeat(own, count.reshape(-1, n).sum(axis=1)))
    for i in np.flatnonzero(width > LONG).tolist():
        paths, totals = search_long(v, buf[offs[i] : offs[i + 1]].tobytes(), n)
        sizes[i, : len(paths)], scores[i, : len(paths)] = [len(p) for p in paths], totals
        parts.append(np.array([x for p in paths for x in p], dtype=np.int64))
        owners.append(np.full(len(parts[-1]), i))
    owner, flat = np.concatenate([*owners, np.zeros(0, np.int64)]), np.concatenate([*parts, np.zeros(0, np.int64)])
    order = np.argsort(owner, kind="stable")
    head = np.concatenate([sizes.astype(np.uint32), np.ascontiguousarray(scores).view(np.uint32)], axis=1)
    total = 3 * n + sizes.sum(axis=1)
    out = np.zeros(int(total.sum()), dtype=np.uint32)
    begin = np.cumsum(total) - total
    place = (begin[:, None] + np.arange(3 * n)).ravel()
    out[place] = head.ravel()
    body = np.ones(len(out), dtype=bool)
    body[place] = False
    out[body] = flat[order]
    return out, total


class Segmented(NamedTuple):
    """N best of the documents first up to last: scores [d, rank], and (ids, bounds) of each rank."""

    first: int
    last: int
    scores: np.ndarray
    paths: list[tuple[np.ndarray, np.ndarray]]


def segment(texts, path: str, n: int = N_BEST) -> Iterator[Segmented]:
    """N-best segmentations of whole texts."""
    v, codes = cell_codes(path, n)
    for s in slices(texts, SLICE):
        size = np.diff(s.offs)
        put = size > 0  # the space before a text; an empty text has none
        buf = np.insert(s.buf, s.offs[:-1][put], 32)
        offs = np.concatenate([[0], np.cumsum(size + put)])
        cells, bounds = cut_chunks(buf, offs, SPACE)
        flat, at, row = codes.of(cells)
        begin = at[row]
        sizes = np.stack([flat[begin + r] for r in range(n)], axis=1).astype(np.int64) if len(row) else np.zeros((0, n), np.int64)
        halves = np.stack([flat[begin + n + r] for r in range(2 * n)], axis=1) if len(row) else np.zeros((0, 2 * n), np.uint32)
        scores = np.ascontiguousarray(halves).view(np.float64)
        starts = begin[:, None] + 3 * n + np.cumsum(sizes, axis=1) - sizes
        choice, totals = _combine(scores, bounds, n)
        paths = []
        for r in range(n):
            pick = np.zeros(len(row), dtype=np.int64)
            for cell, alternative in choice[r]:
                pick[cell] = alternative
            lanes = np.arange(len(row))
            own = sizes[lanes, pick]
            # documents without such a path get no ids
            own = np.where(np.repeat(totals[:, r] > -np.inf, np.diff(bounds)), own, 0)
            ends = np.cumsum(own)
            ids = flat[np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[lanes, pick] - (ends - own), own)]
            paths.append((ids, np.concatenate([[0], ends])[bounds]))
        yield Segmented(s.first, s.last, totals, paths)


def _combine(scores: np.ndarray, bounds: np.ndarray, n: int):
    """For each rank: [(cells, alternatives)] that differ from the best; and total scores [d, rank]."""
    docs = len(bounds) - 1
    best = scores[:, 0] if len(scores) else np.zeros(0)
    totals = np.full((docs, n), -np.inf)
    totals[:, 0] = segment_sums(best, bounds)
    choice: list[list] = [[] for _ in range(n)]
    if n == 1 or not len(scores):
        return choice, totals
    with np.errstate(invalid="ignore"):
        regret = best[:, None] - scores
    cells = np.full((docs, n - 1), -1)
    some = np.flatnonzero(np.diff(bounds))
    left, owner = regret[:, 1].copy(), np.repeat(np.arange(len(some)), np.diff(bounds)[some])
    for j in range(n - 1):
        least = np.minimum.reduceat(left, bounds[some])
        at = np.flatnonzero(left == least[owner])
        first = at[np.searchsorted(owner[at], np.arange(len(some)))]
        cells[some, j] = first
        left[first] = np.inf
    ways = np.array(list(product(range(n), repeat=n - 1)))
    cost = np.zeros((docs, len(ways)))
    for j in range(n - 1):
        taken = (cells[:, j] >= 0) & ~(cells[:, :j] == cells[:, j : j + 1]).any(axis=1)  # a text may have fewer cells
        own = np.where(taken[:, None], regret[np.maximum(cells[:, j], 0)], np.where(np.arange(n) > 0, np.inf, 0.0))
        cost += own[:, ways[:, j]]
    top = np.argsort(cost, axis=1, kind="stable")[:, :n]
    lost = np.take_along_axis(cost, top, 1)
    totals = np.where(np.isfinite(lost), totals[:, :1] - lost, -np.inf)
    for r in range(n):
        for j in range(n - 1):
            alternative = ways[top[:, r], j]
            moved = np.flatnonzero((alternative > 0) & np.isfinite(lost[:, r]))
            choice[r].append((cells[moved, j], alternative[moved]))
    return choice, totals


def decode_pieces(v: Vocabulary, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offs) of the texts that ids stand for; the space before each is taken off."""
    table = np.frombuffer(b"".join(v.pieces), dtype=np.uint8)
    offs = np.concatenate([[0], np.cumsum([len(p) for p in v.pieces])])
    flat, size = ragged_take(table, offs, ids.astype(np.int64))
    ends = np.concatenate([[0], np.cumsum(size)])[bounds]
    keep = np.ones(len(flat), dtype=bool)
    keep[ends[:-1][np.diff(ends) > 0]] = False
    return flat[keep], np.concatenate([[0], np.cumsum(np.maximum(np.diff(ends) - 1, 0))])


def encode_nbest(docs: DataFrame, path: str, n: int = N_BEST, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, rank, score, n_pieces, ids_crc32, decodes of every segmentation, and its ids.

    decodes tells whether decoding the ids gives the whole text back.
    """
    ship(docs.sparkSession)
    names = ["doc_id", "rank", "score", "n_pieces", "ids_crc32", "decodes", *["ids"] * with_ids]

    def encode(batches):
        v = load_vocabulary(path)
        for b in batches:
            for found in segment(b.column(1), path, n):
                size = found.last - found.first
                texts = b.column(1).slice(found.first, size)
                s = next(slices(texts, 1 << 62))
                for r, (ids, bounds) in enumerate(found.paths):
                    own = np.flatnonzero(found.scores[:, r] > -np.inf)
                    wide = ids.astype("<u4")
                    crc = [zlib.crc32(wide[bounds[d] : bounds[d + 1]]) for d in own]
                    flat, offs = decode_pieces(v, ids, bounds)
                    if len(own) == size and len(flat) == len(s.buf) and (offs == s.offs).all() and (flat == s.buf).all():
                        same = [True] * size
                    else:
                        same = [bool(np.array_equal(flat[offs[d] : offs[d + 1]], s.buf[s.offs[d] : s.offs[d + 1]])) for d in own]
                    columns = [b.column(0).slice(found.first, size).take(pa.array(own)), pa.array(np.full(len(own), r + 1, np.int32)), pa.array(found.scores[own, r]), pa.array(np.diff(bounds)[own]), pa.array(crc, pa.int64()), pa.array(same, pa.bool_())]
                    if with_ids:
                        columns.append(pa.array([wide[bounds[d] : bounds[d + 1]].astype(np.int32) for d in own], pa.list_(pa.int32())))
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lean(encode), "doc_id long, rank int, score double, n_pieces long, ids_crc32 long, decodes boolean" + ", ids array<int>" * with_ids)


def decode_ids(rows: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """rows with a column text, decoded from a column of id arrays (null: null)."""
    ship(rows.sparkSession)
    names = rows.columns
    at = names.index(ids_col)

    def decode(batches):
        v = load_vocabulary(path)
        for b in batches:
            text = [None if x is None else b"".join(v.pieces[i] for i in x)[1:].decode("utf-8", "replace") for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(text, pa.string())], names=[*names, "text"])

    return rows.drop("text").select(*names).mapInArrow(lean(decode), rows.schema.simpleString()[7:-1].replace(":", " ") + ", text string")
