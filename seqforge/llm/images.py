"""Copy detection on an image column by local descriptors (operator 4).

1. describe  corners (Harris) of a three-level pyramid, each with an orientation (its intensity centroid)
             and 256 binary tests on the smoothed patch, turned by it; the ``keypoints`` strongest of each
             cell of about CELL pixels a side count, so their number grows with the picture;
2. collapse  images of equal size and pixels are one, with a weight; they are links without descriptors;
3. tables    a descriptor's ten 24-bit parts are keys of ten Hamming tables; images with a key in common
             are joined to groups, and these are dealt to tiles (tiles.py);
4. consensus in a tile, descriptors with an equal part that differ in up to FAR bits are near, and two images with
             two near pairs that agree on a turn are matched: such images have a key in common, so that step 3
             loses no pair that step 4 would try. A link stands if one similarity transform
             (turn, zoom, shift) carries ``inliers`` matches that themselves turn as it does, and one more for
             each doubling of the matches beyond KEYPOINTS.

The result has a row for each image: image_id, class_id (least image_id connected with it by links) and
n_links (the number of other images that it is linked to, equal ones included). Links between all images
are looked for, whatever the number of images that share a key; README.md has the recall of steps 3 and 4
against consensus on all pairs.

Pixels are rows of 8-bit grey; ``decoded`` makes them of files. Images whose pixels are null, empty or not
height x width bytes are classes of their own. Images without corners have links with equal ones only. Rows
of one image_id are one image, that of the least digest if their pixels differ; each keeps its row. Null
image_ids keep their row and no links. An empty table gives an empty result; other columns are ignored. A
task needs about a hundred times the bytes of its largest image's pixels. Images are described where they
are read: a table of few files is to be repartitioned before.

The tables here have no images: the query draws one for each row of ``embeddings`` (scenes), cropped, turned
or brightened by its id, so that close vectors give edited copies of one picture, and for each id n that 20
divides an edited copy besides, as image -n - 1.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, discard, partitions, table
from .components import components
from .tiles import TILE, deal, spread

KEYPOINTS, CELL, INLIERS = 24, 40, 6
#: Images in a tile of a group that is not split; parts that a larger one is split into, and images in a part at most.
TILE_IMAGES, PARTS, MOST = 128, 10, 5000
STACK = 1 << 19  # pixels described at once
LEVELS = (1.0, 1.4, 2.0)
RADIUS, BITS, FAR = 8, 256, 56  # patch radius, tests, most differing bits of a match
_rng = np.random.default_rng(4)
_TESTS = np.clip(_rng.normal(0, RADIUS / 2, (BITS, 2, 2)), -RADIUS, RADIUS)
_GRID = np.stack(np.meshgrid(np.arange(-RADIUS, RADIUS + 1), np.arange(-RADIUS, RADIUS + 1)), -1)
_DISC = ((_GRID**2).sum(-1) <= RADIUS**2).astype(np.float32)
KEYPOINT = np.dtype([("x", "<f4"), ("y", "<f4"), ("turn", "u1"), ("bits", "u1", BITS // 8)])  # turn: 256ths of a circle
#: Bits of a key of the Hamming tables, and 256ths of a circle by which two near pairs may turn apart.
PART, APART = 24, 21
#: Near pairs that are held before they are looked through, and more of them that must come before the next time.
HELD, MORE = 1 << 19, 1 << 18
#: Keypoints of the images whose near pairs are looked for at a time, and corners that are tested at a time.
BLOCK, CORNERS = 1 << 14, 1 << 10
#: Bytes of keypoints sent to a task of tiles, about.
SHIPPED = 1 << 24
_DRAWN = "image_id long, height int, width int, pixels binary"
_KEYED = "image_id long, digest binary, points binary, keys array<long>"


def _blur(x, times=1):
    for _ in range(times):
        p = np.pad(x, ((0, 0), (1, 1), (1, 1)), mode="edge")
        x = (p[:, 1:-1, 1:-1] * 4 + 2 * (p[:, :-2, 1:-1] + p[:, 2:, 1:-1] + p[:, 1:-1, :-2] + p[:, 1:-1, 2:]) + p[:, :-2, :-2] + p[:, :-2, 2:] + p[:, 2:, :-2] + p[:, 2:, 2:]) / 16
    return x


def _resize(x, zoom):
    if zoom == 1:
        return x
    h, w = max(1, int(x.shape[1] / zoom)), max(1, int(x.shape[2] / zoom))
    ys, xs = (np.arange(h) + 0.5) * zoom - 0.5, (np.arange(w) + 0.5) * zoom - 0.5
    y0, x0 = np.clip(ys.astype(int), 0, x.shape[1] - 2 if x.shape[1] > 1 else 0), np.clip(xs.astype(int), 0, x.shape[2] - 2 if x.shape[2] > 1 else 0)
    y1, x1 = np.minimum(y0 + 1, x.shape[1] - 1), np.minimum(x0 + 1, x.shape[2] - 1)
    fy, fx = np.clip(ys - y0, 0, 1)[None, :, None], np.clip(xs - x0, 0, 1)[None, None, :]
    top = x[:, y0][:, :, x0] * (1 - fx) + x[:, y0][:, :, x1] * fx
    return top * (1 - fy) + (x[:, y1][:, :, x0] * (1 - fx) + x[:, y1][:, :, x1] * fx) * fy


def _corners(x):
    """Harris response where it is the largest of its 3 x 3, else 0; the border has none."""
    gy, gx = np.gradient(x, axis=(1, 2))
    a, b, c = _blur(gx * gx, 2), _blur(gy * gy, 2), _blur(gx * gy, 2)
    r = a * b - c * c - 0.05 * (a + b) ** 2
    p = np.pad(r, ((0, 0), (1, 1), (1, 1)), constant_values=np.inf)
    around = np.max([p[:, dy : dy + r.shape[1], dx : dx + r.shape[2]] for dy in range(3) for dx in range(3) if (dy, dx) != (1, 1)], axis=0)
    return np.where((r > around) & (r > 1.0), r, 0)


def describe(stack: np.ndarray, keypoints: int = KEYPOINTS) -> list[np.ndarray]:
    """KEYPOINT arrays of images of one shape (count x height x width), ``keypoints`` for each cell of about CELL pixels a side."""
    levels, found = [], []
    for zoom in LEVELS:
        x = _resize(stack.astype(np.float32), zoom)
        if min(x.shape[1:]) < 7:
            continue
        x = _blur(x)
        image, y, col = np.nonzero(response := _corners(x))
        found.append((np.full(len(image), len(levels)), image, y, col, response[image, y, col]))
        levels.append((zoom, x))
    if not found or not sum(len(c[0]) for c in found):
        return [np.zeros(0, KEYPOINT)] * len(stack)
    level, image, y, col, strength = (np.concatenate(c) for c in zip(*found))
    zooms = np.array([z for z, _ in levels])[level]
    k = np.zeros(len(image), KEYPOINT)
    k["x"], k["y"] = (col + 0.5) * zooms, (y + 0.5) * zooms
    down, across = (max(1, round(n / CELL)) for n in stack.shape[1:])
    cy, cx = (np.minimum((k[c] * m / n).astype(int), m - 1) for c, m, n in (("y", down, stack.shape[1]), ("x", across, stack.shape[2])))
    cell = (image * down + cy) * across + cx
    order = np.lexsort((-strength, cell))
    cell = cell[order]
    order = order[np.arange(len(cell)) - np.searchsorted(cell, cell) < keypoints]
    level, image, y, col, k = level[order], image[order], y[order], col[order], k[order]
    for n, (_, x) in enumerate(levels):
        if len(own := np.flatnonzero(level == n)):
            smooth = np.pad(_blur(x, 2), ((0, 0), (2 * RADIUS, 2 * RADIUS), (2 * RADIUS, 2 * RADIUS)), mode="edge")
            for some in (own[lo : lo + CORNERS] for lo in range(0, len(own), CORNERS)):
                k["turn"][some], k["bits"][some] = _tested(smooth, image[some], y[some], col[some])
    first = np.searchsorted(image, np.arange(len(stack) + 1))
    return [k[a:b] for a, b in zip(first[:-1], first[1:])]


def _tested(smooth, image, y, col):
    """Direction of the centroid around each corner of a smoothed, padded level, and its binary tests turned by it."""
    cy, cx = y + 2 * RADIUS, col + 2 * RADIUS
    patch = smooth[image[:, None, None], cy[:, None, None] + _GRID[..., 1], cx[:, None, None] + _GRID[..., 0]] * _DISC
    angle = np.arctan2((patch * _GRID[..., 1]).sum((1, 2)), (patch * _GRID[..., 0]).sum((1, 2)))
    cos, sin = np.cos(angle)[:, None, None], np.sin(angle)[:, None, None]
    tx = np.rint(_TESTS[None, ..., 0] * cos - _TESTS[None, ..., 1] * sin).astype(int)
    ty = np.rint(_TESTS[None, ..., 0] * sin + _TESTS[None, ..., 1] * cos).astype(int)
    v = smooth[image[:, None, None], cy[:, None, None] + ty, cx[:, None, None] + tx]
    return np.rint(angle * (128 / np.pi)).astype(np.int64) % 256, np.packbits(v[..., 0] < v[..., 1], axis=1)


def _matches(a: np.ndarray, b: np.ndarray):
    """Places of the two images' keypoints that are each other's nearest and within FAR, and their turns."""
    x, y = (np.ascontiguousarray(k["bits"]).view("<u8") for k in (a, b))
    near, least, back, best = [], [], np.zeros(len(b), int), np.full(len(b), 999)
    for lo in range(0, len(a), 256):
        far = sum(np.bitwise_count(x[lo : lo + 256, None, w] ^ y[None, :, w]).astype(np.int64) for w in range(BITS // 64))
        near.append(far.argmin(1))
        least.append(far.min(1))
        low = far.min(0)
        back[low < best] = far.argmin(0)[low < best] + lo
        best = np.minimum(low, best)
    i, j = np.arange(len(a)), np.concatenate(near)
    keep = (np.concatenate(least) <= FAR) & (back[j] == i)
    i, j = i[keep], j[keep]
    return a["x"][i] + 1j * a["y"][i], b["x"][j] + 1j * b["y"][j], _turned(a["turn"][i], b["turn"][j])


def _turned(a, b):
    """The turn between keypoints, as numbers of length 1."""
    return np.exp((b.astype(np.int64) - a) * (2j * np.pi / 256)).astype(np.complex64)


#: The cosine of the angle by which a match's own turn may differ from the transform's: 30 degrees.
ALIKE = np.float32(np.cos(2 * np.pi * APART / 256))


def consensus(a: np.ndarray, b: np.ndarray, enough: int | None = None) -> int:
    """How many matches of two images' keypoints the best similarity transform carries; with ``enough``,
    no more are looked for than that."""
    return _carried(*_matches(a, b), enough) if min(len(a), len(b)) >= 2 else 0


def _carried(pa_, pb, own, enough=None) -> int:
    """The most matches that the transform of two of them carries: within 3 pixels, and turned as it turns."""
    most = 0
    for gap in range(1, len(pa_)):  # pairs of matches, a diagonal of their square at a time
        s = np.arange(len(pa_) - gap)
        span = pa_[s] - pa_[s + gap]
        s, span = s[np.abs(span) > 3], span[np.abs(span) > 3]
        turn = (pb[s] - pb[s + gap]) / span
        usual = (np.abs(turn) > 0.3) & (np.abs(turn) < 3.3)
        s, turn = s[usual], turn[usual]
        for lo in range(0, len(s), 256):
            shift = pb[s[lo : lo + 256]] - turn[lo : lo + 256] * pa_[s[lo : lo + 256]]
            error = np.abs(turn[lo : lo + 256, None] * pa_[None, :] + shift[:, None] - pb[None, :])
            alike = (turn[lo : lo + 256, None] * own.conj()[None, :]).real >= ALIKE * np.abs(turn[lo : lo + 256, None])
            most = max(most, int(((error < 3.0) & alike).sum(1).max()))
            if enough is not None and most >= enough:
                return most
    return most


def _needed(matches: int, inliers: int) -> int:
    return inliers + max(0, int(np.ceil(np.log2(max(1, matches) / KEYPOINTS))))


def linked_by(a: np.ndarray, b: np.ndarray, inliers: int = INLIERS) -> bool:
    """Whether one transform carries ``inliers`` matches, and one more for each doubling of the matches
    beyond KEYPOINTS: as many would be carried by chance."""
    if min(len(a), len(b)) < inliers:
        return False
    pa_, pb, own = _matches(a, b)
    need = _needed(len(pa_), inliers)
    return len(pa_) >= need and _carried(pa_, pb, own, need) >= need


def draw(vectors: np.ndarray, block: int = 5) -> np.ndarray:
    """Pictures of 64-number vectors: 8 x 8 blocks as bright as the numbers, softened."""
    side = vectors.reshape(-1, 8, 8)
    return np.clip(128 + 400 * np.repeat(np.repeat(side, block, 1), block, 2), 0, 255).astype(np.uint8)


_SCENE = np.random.default_rng(11).choice([-1.0, 1.0], (64, 12, 12))


def scenes(vectors: np.ndarray, block: int = 4) -> np.ndarray:
    """Pictures of 64-number vectors of about unit length: a fixed pattern for each number, as strong as it."""
    return np.clip(128 + 50 * np.kron(np.tensordot(vectors, _SCENE, 1), np.ones((1, block, block))), 0, 255).astype(np.uint8)


def edited(picture: np.ndarray, kind: int) -> np.ndarray:
    """A picture as it is (0), cropped by an eighth to a sixth of its sides (1), a quarter turned (2), paler and
    brighter (3), or resized to 1.25 (4) or 0.75 (5) of its sides."""
    if kind == 1:
        return picture[2:-4, 5:-3]
    if kind == 2:
        return np.rot90(picture)
    if kind > 3:
        return np.clip(_resize(picture[None].astype(np.float32), 0.8 if kind == 4 else 4 / 3)[0], 0, 255).astype(np.uint8)
    return np.clip(picture * 0.75 + 40.0, 0, 255).astype(np.uint8) if kind == 3 else picture


def _image_columns(pictures: list[np.ndarray | None]):
    sizes = [pa.array([None if x is None else x.shape[k] for x in pictures], pa.int32()) for k in (0, 1)]
    return [*sizes, pa.array([None if x is None else np.ascontiguousarray(x).tobytes() for x in pictures], pa.binary())]


def _drawings(batches):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, ids, cells = batch.slice(lo, 256), [], []
            for i, v in zip(part["vec_id"].to_pylist(), part["embedding"].to_pylist()):
                whole = v is not None and len(v) == 64 and None not in v and np.isfinite(v).all()
                scene = scenes(np.array(v))[0] if whole else None
                ids.append(i)
                cells.append(edited(scene, (i or 0) % 4) if whole else None)
                if whole and i is not None and i % 20 == 0:
                    ids.append(-i - 1)
                    cells.append(edited(scene, 1 + i // 20 % 5))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *_image_columns(cells)], names=["image_id", "height", "width", "pixels"])


def _vectors(vectors: DataFrame) -> DataFrame:
    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<float>").alias("embedding"))


def drawn(vectors: DataFrame) -> DataFrame:
    """image_id, height, width, pixels of a table of vec_id and embedding; other lengths than 64 give none.

    A row whose vec_id n is divisible by 20 gives a second picture, -n - 1, an edited copy of the first: of
    kinds 1 to 5 in turn."""
    return _vectors(vectors).mapInArrow(_drawings, _DRAWN)


def decoded(files: DataFrame) -> DataFrame:
    """image_id, height, width, pixels of a table of image_id and content, files of the kinds of ``picture``;
    null pixels where a file is null, broken or of another kind. Other columns are ignored."""
    from .pictures import picture

    def run(batches):
        for batch in batches:
            cells = [None if x is None else picture(x) for x in batch["content"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["image_id"], *_image_columns(cells)], names=["image_id", "height", "width", "pixels"])

    return files.select(F.col("image_id").cast("long").alias("image_id"), "content").mapInArrow(run, _DRAWN)


def _described(batches, keypoints: int):
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part, shapes = batch.slice(lo, 256), {}
            rows, digests = [np.zeros(0, KEYPOINT)] * part.num_rows, [None] * part.num_rows
            for i, (h, w, p) in enumerate(zip(*(part[c].to_pylist() for c in ("height", "width", "pixels")))):
                if p and h and w and h * w == len(p):
                    shapes.setdefault((h, w), []).append((i, p))
                    digests[i] = hashlib.blake2b(b"%d %d " % (h, w) + p, digest_size=16).digest()
            for (h, w), every in shapes.items():
                for own in (every[a : a + max(1, STACK // (h * w))] for a in range(0, len(every), max(1, STACK // (h * w)))):
                    stack = np.stack([np.frombuffer(p, np.uint8).reshape(h, w) for _, p in own])
                    for (i, _), k in zip(own, describe(stack, keypoints)):
                        rows[i] = k
            keys = [_keys(k) for k in rows]
            yield pa.RecordBatch.from_arrays([part["image_id"], pa.array(digests, pa.binary()), pa.array([k.tobytes() for k in rows], pa.binary()), pa.array(keys, pa.list_(pa.int64()))], names=["image_id", "digest", "points", "keys"])


def keyed(images: DataFrame, keypoints: int = KEYPOINTS) -> DataFrame:
    """image_id, digest of the pixels (null where they are none), points (KEYPOINT records) and keys of the Hamming tables."""
    return images.select("image_id", "height", "width", "pixels").mapInArrow(lambda batches: _described(batches, keypoints), _KEYED)


def drawn_keyed(vectors: DataFrame, keypoints: int = KEYPOINTS) -> DataFrame:
    """``keyed(drawn(vectors))`` in one Python worker a task instead of two, which would both keep their memory."""
    return _vectors(vectors).mapInArrow(lambda batches: _described(_drawings(batches), keypoints), _KEYED)


def _parts(points: np.ndarray) -> list[np.ndarray]:
    """The PART bits of each descriptor in each of the Hamming tables, as numbers."""
    width = PART // 8
    pieces = points["bits"][:, : BITS // PART * width].reshape(len(points), BITS // PART, width).astype(np.int32)
    return list(np.ascontiguousarray(sum(pieces[..., k] << 8 * k for k in range(width)).T))


def _keys(points: np.ndarray) -> list[int]:
    """Keys of the Hamming tables: a table's number, then its bits."""
    return np.unique([x | t << PART for t, x in enumerate(_parts(points))]).tolist() if len(points) else []


def _sorted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers from 0 on in ascending order, and their places; packed with the place where both fit, as numbers sort faster than places."""
    shift = len(keys).bit_length()
    if not len(keys) or int(keys.max()).bit_length() + shift > 63:
        order = np.argsort(keys)
        return keys[order], order
    packed = np.sort(keys << shift | np.arange(len(keys)))
    return packed >> shift, packed & ((1 << shift) - 1)


class _Alike:
    """Pairs of images, one of ``left`` and one of ``right`` numbers, with two near pairs of keypoints, apart in both,
    that turn alike and as the line between them does; from near pairs as they come."""

    def __init__(self, left: int, right: int, place: np.ndarray):
        self.taken, self.place, self.held, self.size, self.limit = np.zeros((left, right), bool), place, [], 0, HELD
        self.chosen = [np.zeros(0, np.int64)]

    def add(self, pair, turn, i, j):
        fresh = ~self.taken.ravel()[pair]
        self.held.append(tuple(x[fresh] for x in (pair, turn, i, j)))
        self.size += len(self.held[-1][0])
        if self.size > self.limit:
            self.settle()
            self.limit = max(HELD, self.size + MORE)

    def settle(self):
        if not self.held:
            return
        pair, turn, i, j = (np.concatenate(c) for c in zip(*self.held))
        self.held = []
        over = np.flatnonzero(turn < APART)  # a circle's end meets its beginning
        keys = np.concatenate((pair * 512 + turn, pair[over] * 512 + turn[over] + 256))
        keys, of = _sorted(keys)
        late = of >= len(pair)
        of[late] = over[of[late] - len(pair)]
        for gap in range(1, len(keys)):  # until no image pair that is not taken has turns left within reach
            if gap == 1:  # keys of two image pairs are more than APART apart
                at = np.flatnonzero(keys[1:] - keys[:-1] <= APART)
            else:
                at = at[: np.searchsorted(at, len(keys) - gap)]
                at = at[keys[at + gap] - keys[at] <= APART]
            at = at[~self.taken.ravel()[keys[at] >> 9]]
            if not len(at):
                break
            x, y = of[at], of[at + gap]
            a, b = self.place[i[x]] - self.place[i[y]], self.place[j[x]] - self.place[j[y]]
            long, wide = np.abs(a), np.abs(b)
            own = np.exp((keys[at] & 511) * np.complex64(2j * np.pi / 256))
            good = (long > 3) & (wide > 3) & (wide < 3.3 * long) & (wide > 0.3 * long) & ((b * (a * own).conj()).real >= ALIKE * long * wide)
            self.chosen.append(np.unique(pair[x[good]]))
            self.taken.ravel()[self.chosen[-1]] = True
        rest = ~self.taken.ravel()[pair]
        self.held, self.size = [tuple(x[rest] for x in (pair, turn, i, j))], int(rest.sum())

    def pairs(self):
        self.settle()
        return np.divmod(np.unique(np.concatenate(self.chosen)), self.taken.shape[1])


def _met(low: np.ndarray, high: np.ndarray, at_once: int = 1 << 17):
    """Numbers n and all numbers from low[n] to high[n], about ``at_once`` of them at a time."""
    left = np.flatnonzero(high > low)
    low, count = low[left], (high - low)[left]
    till = np.cumsum(count)
    lo = 0
    while lo < len(count):
        hi = max(lo + 1, int(np.searchsorted(till, (till[lo - 1] if lo else 0) + at_once)))
        own = count[lo:hi]
        start = np.repeat(low[lo:hi] - (np.cumsum(own) - own), own)
        yield np.repeat(left[lo:hi], own), start + np.arange(len(start))
        lo = hi


def _near(points: list[np.ndarray], part: np.ndarray | None):
    """Pairs of images (of different parts of two, if given) to be matched, the lower number first, in arrays.

    Images of about BLOCK keypoints at a time are compared with all others, in every table, so that what is
    held of near pairs does not grow with the square of the tile."""
    every = np.frombuffer(b"".join(points), KEYPOINT)
    if not len(every):
        return
    count = np.array([len(p) for p in points])
    own, first = np.repeat(np.arange(len(points), dtype=np.int32), count), np.cumsum(count) - count
    words = [np.ascontiguousarray(w) for w in np.ascontiguousarray(every["bits"]).view("<u8").T]
    place, turn = (every["x"] + 1j * every["y"]).astype(np.complex64), every["turn"].copy()
    parts = [np.concatenate(c) for c in zip(*(_parts(every[lo : lo + BLOCK]) for lo in range(0, len(every), BLOCK)))]
    side = np.ones(len(points), bool) if part is None else part != part.min()
    mine, other, number = np.flatnonzero(side if part is None else ~side), np.flatnonzero(side), np.cumsum(side) - 1
    rows, tables = np.flatnonzero(side[own]), []
    for keys in parts:
        keys, order = _sorted(keys[rows].astype(np.int64))
        tables.append((keys.astype(np.int32), rows[order].astype(np.int32)))
    block = (np.cumsum(count[mine]) - count[mine]) // BLOCK
    for images in np.split(mine, np.flatnonzero(np.diff(block)) + 1):
        found, size = _Alike(len(images), len(other), place), count[images]
        here = np.repeat(np.arange(len(images)), size)
        left = np.repeat(first[images] - (np.cumsum(size) - size), size) + np.arange(len(here))
        for t, (keys, order) in enumerate(tables):
            mark, by = _sorted(parts[t][left].astype(np.int64))
            low, high = (np.searchsorted(keys, mark.astype(np.int32), end) for end in ("left", "right"))
            if part is None:  # only those behind
                at = np.empty(len(order), np.int64)
                at[order] = np.arange(len(order))
                low = at[left[by]] + 1
            ours, theirs = ([w[k] for w in words] for k in (left[by], order))  # rows that meet lie together
            for i, j in _met(low, high):
                far = np.bitwise_count(ours[0][i] ^ theirs[0][j]).astype(np.uint16)
                for v, w in zip(ours[1:], theirs[1:]):
                    far += np.bitwise_count(v[i] ^ w[j])
                close = np.flatnonzero(far <= FAR)
                n, j = by[i[close]], order[j[close]]
                i = left[n]
                fresh = own[i] != own[j]
                for earlier in parts[:t]:
                    fresh &= earlier[i] != earlier[j]
                n, i, j = n[fresh], i[fresh], j[fresh]
                pair = here[n] * len(other) + number[own[j]]
                i, j = np.minimum(i, j).astype(np.int32), np.maximum(i, j).astype(np.int32)
                found.add(pair, turn[j] - turn[i], i, j)
        x, y = found.pairs()
        x, y = images[x], other[y]
        yield np.minimum(x, y), np.maximum(x, y)


def _tried(points: list[np.ndarray], part: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of ``_near``."""
    none = np.zeros(0, np.int64)
    i, j = (np.concatenate(c) for c in zip((none, none), *_near(points, part)))
    return i, j


def _linked(points: list[np.ndarray], i: np.ndarray, j: np.ndarray, inliers: int, most: int = 256, cells: int = 1 << 19) -> np.ndarray:
    """linked_by of images i and j; pairs of up to ``most`` keypoints each in batches of about ``cells`` comparisons."""
    count = np.array([len(p) for p in points])
    larger, out = np.maximum(count[i], count[j]), np.zeros(len(i), bool)
    for k in np.flatnonzero(larger > most).tolist():
        out[k] = linked_by(points[i[k]], points[j[k]], inliers)
    every = np.frombuffer(b"".join(points), KEYPOINT)
    first = np.cumsum(count) - count
    words, place, turn = np.ascontiguousarray(every["bits"]).view("<u8"), (every["x"] + 1j * every["y"]).astype(np.complex64), every["turn"].copy()
    fit = np.flatnonzero((larger <= most) & (np.minimum(count[i], count[j]) >= inliers))
    fit = fit[np.argsort(larger[fit], kind="stable")]
    lo = 0
    while lo < len(fit):
        width = -(-int(larger[fit[lo]]) // 8) * 8
        own = fit[lo : min(lo + max(1, cells // width**2), int(np.searchsorted(larger[fit], width, side="right")))]
        lo += len(own)
        rank, (x, y) = np.arange(width), (i[own], j[own])
        u, v = (np.minimum(first[k][:, None] + rank, len(every) - 1) for k in (x, y))
        a, b = words[u], words[v]
        far = np.zeros((len(own), width, width), np.uint16)
        for w in range(BITS // 64):
            far += np.bitwise_count(a[:, :, None, w] ^ b[:, None, :, w])
        far[(rank >= count[x][:, None])[:, :, None] | (rank >= count[y][:, None])[:, None, :]] = 999
        near, back = far.argmin(2), far.argmin(1)
        keep = (np.take_along_axis(far, near[:, :, None], 2)[..., 0] <= FAR) & (np.take_along_axis(back, near, 1) == rank)
        matches = keep.sum(1)
        for m in np.unique(matches[matches >= inliers]).tolist():
            rows, need = np.flatnonzero(matches == m), _needed(m, inliers)
            at = np.nonzero(keep[rows])[1].reshape(len(rows), m)
            to = np.take_along_axis(v[rows], near[rows[:, None], at], 1)
            at = np.take_along_axis(u[rows], at, 1)
            if len(k := np.flatnonzero(_may_turn(turn[to] - turn[at], need))):
                out[own[rows[k]]] = _carry(place[at[k]], place[to[k]], _turned(turn[at[k]], turn[to[k]]), need)
    return out


def _may_turn(turn: np.ndarray, need: int) -> np.ndarray:
    """Whether ``need`` of each row's turns (256ths of a circle) lie in an arc as wide as those that one transform carries."""
    some = np.zeros(len(turn), bool)
    for k in range(turn.shape[1]):
        some |= (turn - turn[:, k : k + 1] <= 2 * APART + 1).sum(1) >= need
    return some


def _carry(pa_, pb, own, need: int, cells: int = 1 << 17) -> np.ndarray:
    """Whether _carried of each row is ``need`` or more; rows that have a transform are done, and a transform that
    fewer matches turn like is not tried."""
    m = pa_.shape[1]
    s, t = np.triu_indices(m, 1)
    order = np.argsort(t - s, kind="stable")
    s, t, own = s[order], t[order], own.conj()
    out = np.zeros(len(pa_), bool)
    for first in range(0, len(pa_), step := max(1, cells // m**2)):
        left, lo = np.arange(first, min(first + step, len(pa_))), 0
        while lo < len(s) and len(left):
            a, b = s[lo : (hi := lo + max(m, cells // (m * len(left))))], t[lo:hi]
            lo = hi
            x, y = pa_[left], pb[left]
            span = x[:, a] - x[:, b]
            fine = np.abs(span) > 3
            turn = (y[:, a] - y[:, b]) / np.where(fine, span, 1)
            size = np.abs(turn)
            row, hyp = np.nonzero(fine & (size > 0.3) & (size < 3.3))
            turn, size, row, a = turn[row, hyp], size[row, hyp], left[row], a[hyp]
            alike = (turn[:, None] * own[row]).real >= ALIKE * size[:, None]
            k = np.flatnonzero(alike.sum(1) >= need)
            row, a, turn, alike = row[k], a[k], turn[k], alike[k]
            shift = pb[row, a] - turn * pa_[row, a]
            near = np.abs(turn[:, None] * pa_[row] + shift[:, None] - pb[row]) < 3.0
            out[row[(near & alike).sum(1) >= need]] = True
            left = left[~out[left]]
    return out


def _compare(group: pa.Table, inliers: int) -> pa.Table:
    """One tile: for each image the weight of the others that it is linked to here, and the least of them."""
    group = group.take(pa.array(np.argsort(group["node"].to_numpy())))
    mode, tile, a, b = (group[c][0].as_py() for c in TILE)
    ids, weight = group["node"].to_numpy(), group["copies"].to_numpy()
    points = [np.frombuffer(x.as_buffer(), KEYPOINT) for x in group["points"].combine_chunks()]
    keys = [_keys(p) for p in points] if mode else None
    root, n, linked = list(range(len(ids))), [0] * len(ids), set()

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    for i, j in _near(points, group["part"].to_numpy() if a != b else None):
        if mode:  # a pair belongs to the tile of its least common key
            here = [min(set(keys[x]) & set(keys[y])) == tile for x, y in zip(i.tolist(), j.tolist())]
            i, j = i[here], j[here]
        some = _linked(points, i, j, inliers)
        for x, y in zip(i[some].tolist(), j[some].tolist()):
            n[x], n[y] = n[x] + int(weight[y]), n[y] + int(weight[x])
            linked |= {x, y}
            x, y = sorted((find(x), find(y)))
            root[y] = x
    own = sorted(linked)
    return pa.table([pa.array(c, pa.int64()) for c in ([int(ids[k]) for k in own], [n[k] for k in own], [int(ids[find(k)]) for k in own])], names=["node", "links", "other"])


def copies(images: DataFrame, keypoints: int = KEYPOINTS, inliers: int = INLIERS, tile: int = TILE_IMAGES) -> DataFrame:
    """image_id, class_id, n_links: a row for each image."""
    return linked_copies(keyed(images, keypoints), inliers, tile)


def linked_copies(described: DataFrame, inliers: int = INLIERS, tile: int = TILE_IMAGES) -> DataFrame:
    """``copies`` of what ``keyed`` has made of images."""
    held = cut(described, "described")
    ids, fewest = cut(held.select("image_id", "digest"), "ids"), partitions(held)
    one = ids.where("image_id IS NOT NULL AND digest IS NOT NULL").groupBy("image_id").agg(F.min("digest").alias("digest"))
    reps = cut(one.groupBy("digest").agg(F.min("image_id").alias("node"), F.count("*").alias("copies")), "reps")
    named = one.join(reps, "digest").select(F.col("image_id").alias("id"), "node", "copies")
    own = held.join(reps.select(F.col("digest").alias("d"), "node", "copies"), (F.col("image_id") == F.col("node")) & (F.col("digest") == F.col("d")))
    own = cut(own.select("node", "copies", "points", "keys").dropDuplicates(["node"]), "own")
    discard(held)
    sized = own.select("node", F.length("points").cast("long").alias("size"))
    dealt = cut(deal(own.select("node", F.length("points").cast("long").alias("size"), "keys"), max(1, tile // 2), MOST, PARTS), "dealt").hint("merge")  # small as a file only
    sent = sized.join(dealt, "node").agg(F.sum(F.col("size") * F.aggregate("deals", F.lit(0).cast("long"), lambda n, d: n + d["parts"]))).first()[0] or 0
    tiles = spread(own.select("node", "copies", "points").join(dealt, "node"), "copies", "points").repartition(max(fewest, sent // SHIPPED + 1), *TILE)
    linked = cut(tiles.groupBy(*TILE).applyInArrow(lambda g: _compare(g, inliers), "node long, links long, other long"), "linked")
    count = linked.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "n")
    classes = components(linked.select(F.col("node").alias("a"), F.col("other").alias("b"))).select(F.col("node").alias("c"), "root")
    out = ids.select("image_id").join(named, F.col("image_id") == F.col("id"), "left").join(classes, F.col("node") == F.col("c"), "left").join(count, F.col("node") == F.col("n"), "left")
    links = F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1
    return out.select("image_id", F.coalesce("root", "node", "image_id").alias("class_id"), links.cast("long").alias("n_links"))


def op4_image_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return linked_copies(drawn_keyed(vectors.repartition(partitions(vectors, 1 << 19))))
