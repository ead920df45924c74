"""Cropped and edited copies among images, by local descriptors.

Corners are found at several scales; each has an orientation from the intensity centroid around it and a
binary descriptor of intensity tests rotated by it. Descriptors meet in hash tables over choices of their bits,
so those within a small Hamming distance often share a table entry, and images with one such descriptor are compared. Matches of two images must agree on
one similarity transform (shift, scale, rotation); the agreeing ones are counted, and links form classes.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwork.llm.buckets import one_of_equal, stars, tiles
from siftwork.llm.common import ByteHash, mix, release_memory, rows_by_bytes, stored
from siftwork.llm.components import components

#: Corners kept at each scale (full, half, quarter) of any image, strongest first; besides, all that are the
#: strongest within APART pixels at their scale, which depends on nearby pixels only: a crop keeps those inside it.
CORNERS, APART = (10, 5, 2), 42
#: 32-bit words of a descriptor; hash tables, and the bits of a key, drawn for each table.
WORDS, TABLES, TABLE_BITS = 3, 6, 24
#: Radius of the patch around a corner, and how far its tests reach.
RADIUS = 9
#: Most differing bits of a match, least agreeing matches of a link, and pixels they may be off at scale 1.
HAMMING, AGREE, OFF = 7, 4, 3.0
#: Radians by which the turn of an agreeing match may differ from the transform's.
TURN = 0.4
#: Of table entries with more descriptors than this, the like ones of so many images are compared with a pivot, then in tiles of two blocks with so many descriptor bytes.
SMALL, BLOCK = 16, 96 << 10
#: Matches that are held, or pairs of them that are compared, at once.
CELLS = 1 << 16
#: Pixels that are described together.
SHEET = 1 << 17
#: Larger pictures count as unreadable, since a task decodes a picture whole.
MOST_PIXELS = 1 << 27


def decode(data: bytes | None) -> np.ndarray | None:
    """Grey pixels (rows, columns) of a binary PGM or PPM or an 8-bit PNG without interlacing; None if it is none of them."""
    try:
        if data and data[:2] in (b"P5", b"P6"):
            m = re.match(rb"P[56]\s+(?:#[^\n]*\n\s*)*(\d+)\s+(\d+)\s+255\s", data)
            w, h, k = int(m[1]), int(m[2]), 1 if data[:2] == b"P5" else 3
            if w * h > MOST_PIXELS:
                return None
            pixels = np.frombuffer(data, np.uint8, w * h * k, m.end()).reshape(h, w, k)
            return pixels[..., 0] if k == 1 else pixels.mean(axis=2)
        if data and data[:8] == b"\x89PNG\r\n\x1a\n":
            return _png(data)
    except (TypeError, ValueError, KeyError, struct.error, zlib.error):
        return None
    return None


def _png(data: bytes) -> np.ndarray | None:
    at, packed, size = 8, b"", None
    while at + 8 <= len(data):
        n, kind = struct.unpack(">I4s", data[at : at + 8])
        body = data[at + 8 : at + 8 + n]
        if kind == b"IHDR":
            size = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            packed += body
        at += n + 12
    w, h, depth, colour, _, _, interlaced = size
    k = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    if depth != 8 or interlaced or w * h > MOST_PIXELS:
        return None
    lines = np.frombuffer(zlib.decompressobj().decompress(packed, h * (w * k + 1)), np.uint8).reshape(h, w * k + 1)
    out = np.zeros((h + 1, w + 1, k), np.int64)
    for y in range(h):  # PNG's line filters: none, left, above, mean of both, nearest of three
        line, how = lines[y, 1:].reshape(w, k).astype(np.int64), lines[y, 0]
        row, up = out[y + 1], out[y]
        if how in (0, 2):
            row[1:] = line + (up[1:] if how == 2 else 0)
        elif how == 1:
            row[1:] = np.cumsum(line, axis=0)
        else:
            for x in range(1, w + 1):
                a, b, c = row[x - 1], up[x], up[x - 1]
                if how == 3:
                    guess = (a + b) // 2
                else:
                    pa_, pb, pc = abs(b - c), abs(a - c), abs(a + b - 2 * c)
                    guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, c))
                row[x] = (line[x - 1] + guess) & 255
        row &= 255
    return out[1:, 1:, : 1 if k < 3 else 3].mean(axis=2)


def pgm(pixels: np.ndarray) -> bytes:
    whole = pixels if pixels.dtype == np.uint8 else np.clip(np.rint(pixels), 0, 255).astype(np.uint8)
    return b"P5 %d %d 255\n" % (pixels.shape[1], pixels.shape[0]) + whole.tobytes()


def _tests() -> np.ndarray:
    """Pairs of points (tests, 2, xy) for 32 orientations: fixed draws around the corner, then rotated."""
    rng = np.random.default_rng(1)
    points = np.clip(rng.normal(0, RADIUS / 2.2, (WORDS * 32, 2, 2)), -RADIUS * 0.7, RADIUS * 0.7)
    turns = np.arange(32) * 2 * np.pi / 32
    c, s = np.cos(turns), np.sin(turns)
    x, y = points[..., 0], points[..., 1]
    return np.rint(np.stack([c[:, None, None] * x - s[:, None, None] * y, s[:, None, None] * x + c[:, None, None] * y], axis=-1)).astype(np.int64)


def _chosen() -> np.ndarray:
    """The descriptor bits (TABLES, TABLE_BITS) of each table's keys: each four tables share out all bits."""
    rng = np.random.default_rng(2)
    return np.concatenate([rng.permutation(WORDS * 32).reshape(-1, TABLE_BITS) for _ in range(-(-TABLES * TABLE_BITS // (WORDS * 32)))])[:TABLES]


TESTS, CHOSEN = _tests(), _chosen()
_GRID = np.mgrid[-RADIUS : RADIUS + 1, -RADIUS : RADIUS + 1].reshape(2, -1)
_DISC = _GRID[:, (_GRID**2).sum(axis=0) <= RADIUS**2]


@lru_cache(256)
def _steps(width: int) -> tuple[np.ndarray, np.ndarray]:
    """_DISC and TESTS as steps between pixels that lie row after row."""
    return _DISC[0] * width + _DISC[1], TESTS[..., 1] * width + TESTS[..., 0]


def _box(a: np.ndarray, width: int) -> np.ndarray:
    """Sums over 3 x 3 of the pixels given row after row, for all but the first and last width + 1.

    In one run over all rows; what it takes from the next row lies on the border, where no corner is looked for.
    """
    b = a[: -2 * width] + a[width:-width]
    b += a[2 * width :]
    out = b[:-2] + b[1:-1]
    out += b[2:]
    return out


def _alone(y: np.ndarray, x: np.ndarray, strength: np.ndarray, reach: int) -> np.ndarray:
    """True for peaks, given by rows, with no stronger one within so many rows and columns."""
    out = np.zeros(len(y), bool)
    if not len(y):
        return out
    # Peaks of one cell are within reach of each other, so only the strongest of a cell can be alone.
    cell = y // (reach + 1) * (int(x.max()) // (reach + 1) + 1) + x // (reach + 1)
    top = np.zeros(int(cell.max()) + 1, strength.dtype)
    np.maximum.at(top, cell, strength)
    some = np.flatnonzero(strength >= top[cell])
    # These are compared with each other first, then with all that are stronger than the weakest left.
    some = some[_unmatched(y, x, strength, some, some, reach)]
    stronger = np.flatnonzero(strength > strength[some].min())
    out[some[_unmatched(y, x, strength, some, stronger, reach)]] = True
    return out


def _unmatched(y: np.ndarray, x: np.ndarray, strength: np.ndarray, some: np.ndarray, others: np.ndarray, reach: int) -> np.ndarray:
    """True for those of some that no stronger one of others is within reach of; both are places, in the order of rows."""
    out, (oy, ox, os) = np.ones(len(some), bool), (v[others] for v in (y, x, strength))
    first, last = np.searchsorted(oy, y[some] - reach), np.searchsorted(oy, y[some] + reach + 1)
    for a in range(0, len(some), 8):
        own, near = some[a : a + 8, None], slice(first[a], last[min(a + 7, len(some) - 1)])
        close = os[near] > strength[own]
        close &= np.abs(y[own] - oy[near]) <= reach
        close &= np.abs(x[own] - ox[near]) <= reach
        out[a : a + 8] = ~close.any(axis=1)
    return out


def _may_lead(of: np.ndarray, strength: np.ndarray, most: int) -> np.ndarray:
    """True for the `most` strongest peaks of each image and few others; `of` is in order."""
    start = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
    size = np.diff(np.append(start, len(of)))
    # So many parts of an image have a peak each at least as strong as the weakest of their strongest.
    parts = np.minimum(size, most)
    number = np.arange(int(parts.sum())) - np.repeat(np.cumsum(parts) - parts, parts)
    strongest = np.maximum.reduceat(strength, np.repeat(start, parts) + number * np.repeat(size, parts) // np.repeat(parts, parts))
    return strength >= np.repeat(np.minimum.reduceat(strongest, np.cumsum(parts) - parts), size)


def table_keys(bits: np.ndarray) -> np.ndarray:
    """Keys (n, TABLES) of descriptors, which name their table too."""
    each = np.unpackbits(np.ascontiguousarray(bits).view(np.uint8).reshape(len(bits), WORDS * 4), axis=1, bitorder="little")
    return (each[:, CHOSEN].astype(np.int64) << np.arange(TABLE_BITS)).sum(axis=2) * TABLES + np.arange(TABLES)


def describe(pixels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Corners (n, 4): x, y at full size, scale, angle; descriptors (n, WORDS) of 32 bits. None for small or flat images."""
    return describe_all([pixels])[0]


def describe_all(images: list[np.ndarray]) -> list[tuple[np.ndarray, np.ndarray]]:
    """What describe gives for each image; those of like widths are worked on together, one above the other."""
    out: list = [None] * len(images)
    order = sorted(range(len(images)), key=lambda i: images[i].shape[1])
    start, area = 0, 0
    for k, i in enumerate(order):
        h, w = images[i].shape
        if k > start and (area + h * w > SHEET or w > 1.2 * images[order[start]].shape[1] + 4):
            _describe_sheet(images, order[start:k], out)
            start, area = k, 0
        area += h * w
    if order:
        _describe_sheet(images, order[start:], out)
    return out


def _describe_sheet(images: list[np.ndarray], which: list[int], out: list) -> None:
    """Puts into out what describe gives for these images. Nothing within RADIUS + 1 of an image's border is a corner, so none depends on its neighbours."""
    h, w = (np.array([images[i].shape[axis] for i in which]) for axis in (0, 1))
    unit = 1 << (len(CORNERS) - 1)
    top = np.cumsum(np.r_[0, -(-h // unit) * unit])  # a multiple, so that halving keeps images apart
    image = np.zeros((top[-1], -(-w.max() // unit) * unit), np.float32)
    for i, y in zip(which, top.tolist(), strict=False):
        image[y : y + images[i].shape[0], : images[i].shape[1]] = images[i]
    own, corners, bits = [np.zeros(0, np.int64)], [np.zeros((0, 4))], [np.zeros((0, WORDS), np.uint32)]
    edge = RADIUS + 1
    for level, most in enumerate(CORNERS):
        if level:
            image = (image[::2, ::2] + image[1::2, ::2] + image[::2, 1::2] + image[1::2, 1::2]) / 4
            h, w, top = h // 2, w // 2, top // 2
        fits = np.minimum(h, w) >= 2 * RADIUS + 3
        if not fits.any():
            break
        width = image.shape[1]
        smooth = _box(image.ravel(), width)  # from pixel `width + 1` on, as each of the next two steps starts so much later
        smooth *= np.float32(1 / 9)
        dy, dx = smooth[2 * width + 1 : -1] - smooth[1 : -2 * width - 1], smooth[width + 2 : -width] - smooth[width:-width - 2]
        xx, yy = _box(dx * dx, width), _box(dy * dy, width)
        dx *= dy
        half = _box(dx, width)
        half *= half
        apart = xx - yy
        apart /= 2
        apart *= apart
        half += apart
        strength = xx
        strength += yy
        strength /= 2
        strength -= np.sqrt(half, out=half)  # the smaller eigenvalue
        across = np.maximum(strength[: -2 * width], strength[2 * width :])
        np.maximum(across, strength[width:-width], out=across)
        inner = strength[width + 1 : -width - 1]
        highest = np.maximum(across[:-2], across[2:])
        np.maximum(highest, across[1:-1], out=highest)
        peak = inner >= highest
        peak &= inner > 25
        at = np.flatnonzero(peak)
        strength = inner[at]
        at += 4 * (width + 1)
        y = at // width
        x = at - y * width
        of = np.searchsorted(top, np.arange(image.shape[0]), side="right")[y] - 1
        row = y - top[of]
        inside = (row >= edge) & (row < (h - edge)[of]) & (x >= edge) & (x < (w - edge)[of]) & fits[of]
        at, x, of, row, strength = at[inside], x[inside], of[inside], row[inside], strength[inside]
        if not len(at):
            continue
        # Cells of different images are kept apart.
        apart = np.cumsum(np.r_[0, (h // (APART + 1) + 2) * (APART + 1)])
        alone = _alone(row + apart[of], x, strength, APART)
        some = np.flatnonzero(alone | _may_lead(of, strength, most))
        at, x, of, row, strength, alone = at[some], x[some], of[some], row[some], strength[some], alone[some]
        order = np.lexsort((-strength, of))
        place = np.arange(len(order)) - np.searchsorted(of, of)  # of is in order, before and after
        order = order[alone[order] | (place < most)]
        at, x, of, row = at[order], x[order], of[order], row[order]
        disc, tests = _steps(width)
        for a in range(0, len(at), 2048):
            part = slice(a, a + 2048)
            centre = at[part, None] - (width + 1)
            patch = smooth.take(centre + disc).astype(np.float64)
            angle = np.arctan2(*(np.einsum("ij,j->i", patch, d.astype(np.float64)) for d in _DISC))
            turn = np.rint(angle / (2 * np.pi / 32)).astype(np.int64) % 32
            value = smooth.take(tests[turn] + centre[..., None])
            tested = value[..., 0] < value[..., 1]
            bits.append(np.packbits(tested.reshape(len(turn), WORDS, 32), axis=2, bitorder="little").view(np.uint32)[..., 0])
            scale = 2.0**level
            corners.append(np.stack([(x[part] + 0.5) * scale, (row[part] + 0.5) * scale, np.full(len(turn), scale), angle], axis=1))
            own.append(of[part])
    of = np.concatenate(own)
    order = np.argsort(of, kind="stable")
    ends = np.searchsorted(of[order], np.arange(len(which) + 1))
    corners, bits = np.concatenate(corners)[order], np.concatenate(bits)[order]
    for k, i in enumerate(which):
        out[i] = corners[ends[k] : ends[k + 1]], bits[ends[k] : ends[k + 1]]


def digest(pixels: np.ndarray) -> int:
    whole = pixels if pixels.dtype == np.uint8 else np.rint(pixels).astype(np.uint8)
    data = repr(pixels.shape).encode() + whole.tobytes()
    return int.from_bytes(hashlib.blake2b(data, digest_size=8).digest(), "little", signed=True)


def _described(images: DataFrame) -> DataFrame:
    """media_id, digest (of the pixels, null if unreadable), corners (four columns of float32, one after another), bits (32-bit rows), node (a number of its own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, "image", 4 << 20):
            pixels = [decode(data) for data in batch.column(1).to_pylist()]
            node = [None if p is None else digest(p) for p in pixels]
            found = iter(describe_all([p for p in pixels if p is not None]))
            none = np.zeros((0, 4)), np.zeros((0, WORDS), np.uint32)
            each = [none if p is None else next(found) for p in pixels]
            corners, bits = [c.T.astype(np.float32).tobytes() for c, _ in each], [b.tobytes() for _, b in each]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(node, pa.int64()), pa.array(corners, pa.binary()), pa.array(bits, pa.binary())], names=["media_id", "digest", "corners", "bits"])

    found = images.select(F.col("media_id").cast("long").alias("media_id"), F.col("image")).mapInArrow(run, "media_id long, digest long, corners binary, bits binary")
    return found.withColumn("node", F.monotonically_increasing_id())


def _corners(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float32).reshape(4, -1).T


def _apart(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """How many bits differ."""
    out = np.bitwise_count(one[..., 0] ^ two[..., 0])
    for k in range(1, WORDS):
        out += np.bitwise_count(one[..., k] ^ two[..., k])
    return out


def _like(ba: np.ndarray, bb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the descriptors of two images that are within HAMMING, some rows at a time."""
    step = max(1, (1 << 20) // max(1, len(bb)))
    found = [np.flatnonzero(_apart(ba[k : k + step, None], bb[None]) <= HAMMING) + k * len(bb) for k in range(0, len(ba), step)]
    i, j = np.divmod(found[0] if len(found) == 1 else np.concatenate([*found, np.zeros(0, np.int64)]), max(1, len(bb)))
    return i, j


def agreeing(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], enough: float = np.inf) -> int:
    """The most corners of a that one similarity transform maps onto corners of b with like descriptors; ends when enough are found."""
    (ca, ba), (cb, bb) = a, b
    if not len(ca) or not len(cb):
        return 0
    i, j = _like(ba, bb)
    if enough < np.inf and min(len(set(i.tolist())), len(set(j.tolist()))) < enough:
        return 0
    turns, best = cb[j, 3] - ca[i, 3], 0
    for k in range(len(i)):
        scale, turn = cb[j[k], 2] / ca[i[k], 2], turns[k]
        c, s = scale * np.cos(turn), scale * np.sin(turn)
        d = ca[i, :2] - ca[i[k], :2]
        landed = np.stack([c * d[:, 0] - s * d[:, 1], s * d[:, 0] + c * d[:, 1]], axis=1) + cb[j[k], :2]
        near = ((landed - cb[j, :2]) ** 2).sum(axis=1) <= (OFF * max(1.0, scale) * cb[j, 2]) ** 2
        near &= np.cos(turns - turn) >= np.cos(TURN)
        best = max(best, min(len(set(i[near].tolist())), len(set(j[near].tolist()))))
        if best >= enough:
            break
    return best


def _flat(column: pa.Array, dtype: type, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The binaries of a column one after another, as numbers, and how many corners each has at so many numbers a corner."""
    size = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // (4 * width)
    return np.frombuffer(b"".join(column.to_pylist()), dtype), size


def _stepped(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1 and so on, `size` of each, one after another."""
    return np.arange(int(size.sum())) + np.repeat(first - np.cumsum(size) + size, size)


def _cuts(cost: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Runs of rows of about that cost together, or of one row."""
    group = np.cumsum(cost) // most
    start = np.flatnonzero(np.append(True, group[1:] != group[:-1])[: len(group)])
    return list(zip(start.tolist(), np.append(start, len(cost))[1:].tolist(), strict=True))


def agreeing_rows(batch: pa.RecordBatch) -> np.ndarray:
    """For each row of corners and bits of two images (ca, ba, cb, bb): whether agreeing finds AGREE. The matches of several rows are worked on together."""
    (fa, na), (fb, nb) = _flat(batch["ca"], np.float32, 4), _flat(batch["cb"], np.float32, 4)
    # Each word of the descriptors lies by itself.
    wa, wb = (np.asfortranarray(_flat(batch[c], np.uint32, WORDS)[0].reshape(-1, WORDS)) for c in ("ba", "bb"))
    ea, eb = np.cumsum(na), np.cumsum(nb)
    # Corners as rows (x, y, scale, angle).
    xa, xb = (f[_stepped(4 * (e - n), n)[:, None] + np.repeat(n, n)[:, None] * np.arange(4)] for f, n, e in ((fa, na, ea), (fb, nb, eb)))
    out, rows, first, second, held = np.zeros(len(na), bool), [], [], [], 0
    for row, (sa, ta, sb, tb) in enumerate(zip((ea - na).tolist(), ea.tolist(), (eb - nb).tolist(), eb.tolist(), strict=True)):
        i, j = _like(wa[sa:ta], wb[sb:tb])
        if len(i) >= AGREE:
            rows.append(row)
            first.append(i + sa)
            second.append(j + sb)
            held += len(i)
        if rows and (held > CELLS or row == len(na) - 1):
            of = np.repeat(np.arange(len(rows)), [len(i) for i in first])
            out[rows] = _agreeing_matches(xa, xb, np.concatenate(first), np.concatenate(second), of, len(rows))
            rows, first, second, held = [], [], [], 0
    return out


def _agreeing_matches(xa: np.ndarray, xb: np.ndarray, i: np.ndarray, j: np.ndarray, of: np.ndarray, rows: int) -> np.ndarray:
    """Whether AGREE of the matches (i, j) of each row agree, given by row and i."""

    def several(group: np.ndarray, corner: np.ndarray, groups: int) -> np.ndarray:
        key = np.unique(group * (int(corner.max(initial=0)) + 1) + corner)
        return np.bincount(key // (int(corner.max(initial=0)) + 1), minlength=groups) >= AGREE

    out = np.zeros(rows, bool)
    open_ = several(of, i, rows) & several(of, j, rows)
    keep = open_[of]
    i, j, of = i[keep], j[keep], of[keep]
    if not len(of):
        return out
    turns, scale = xb[j, 3] - xa[i, 3], xb[j, 2] / xa[i, 2]
    c, s = scale * np.cos(turns), scale * np.sin(turns)
    n = np.bincount(of, minlength=rows)
    first = np.cumsum(n) - n
    # The transform of each match against all matches of its row, until one agrees: first those of each row's first match, then of more.
    done, step = 0, 1
    while len(rest := np.flatnonzero((n > done) & ~out)):
        tried = _stepped(first[rest] + done, np.minimum(n[rest] - done, step))
        for a, b in _cuts(n[of[tried]], CELLS):
            own = tried[a:b][~out[of[tried[a:b]]]]
            size = n[of[own]]
            m, place = _stepped(first[of[own]], size), np.repeat(np.arange(len(own)), size)
            k = own[place]
            dx, dy = xa[i[m], 0] - xa[i[k], 0], xa[i[m], 1] - xa[i[k], 1]
            x, y = c[k] * dx - s[k] * dy + xb[j[k], 0], s[k] * dx + c[k] * dy + xb[j[k], 1]
            near = (x - xb[j[m], 0]) ** 2 + (y - xb[j[m], 1]) ** 2 <= (OFF * np.maximum(1.0, scale[k]) * xb[j[m], 2]) ** 2
            near &= np.cos(turns[m] - turns[k]) >= np.cos(TURN)
            m, place = m[near], place[near]
            agree = several(place, i[m], len(own)) & several(place, j[m], len(own))
            out[of[own[agree]]] = True
        done, step = done + step, 2 * step
    return out


def _entries(nodes: DataFrame) -> DataFrame:
    """key, node, fold for each table and corner of the nodes, like ones once; folds differ in no more bits than descriptors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, "bits", 64 << 10):
            data = batch.column(1)
            bits = np.frombuffer(b"".join(data.to_pylist()), np.uint32).reshape(-1, WORDS)
            of = np.repeat(np.arange(batch.num_rows), pc.binary_length(data).to_numpy(zero_copy_only=False) // (4 * WORDS))
            both = table_keys(bits).astype(np.uint64) << np.uint64(32) | np.bitwise_xor.reduce(bits, axis=1)[:, None]
            of, both = np.repeat(of, TABLES), both.ravel()
            order = np.lexsort((both, of))
            of, both = of[order], both[order]
            new = np.append(True, (of[1:] != of[:-1]) | (both[1:] != both[:-1]))[: len(of)]
            halves = both[new].view(np.int32).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 1]), batch.column(0).take(pa.array(of[new])), pa.array(halves[:, 0])], names=["key", "node", "fold"])

    # An image with fewer corners has no link.
    return nodes.select("node", "bits").where(F.octet_length("bits") >= AGREE * 4 * WORDS).mapInArrow(run, "key int, node long, fold int")


def _met(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of nodes that share an entry with like folds: bucket null, or as the members a of a bucket, b null, where these are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        for batch in batches:
            key = batch.column(0)
            if not batch.num_rows:
                continue
            if kept and key[batch.num_rows - 1] == kept[0].column(0)[0]:
                kept.append(batch)
                continue
            # All but the last entry of the batch are whole.
            last = int(np.searchsorted(key.to_numpy(), key[batch.num_rows - 1].as_py()))
            yield from _meetings([*kept, batch.slice(0, last)])
            kept = [batch.slice(last)]
        if kept:
            yield from _meetings(kept)

    dealt = _entries(nodes).repartition("key").sortWithinPartitions("key", "fold", "node")
    return dealt.mapInArrow(run, "bucket long, a long, b long")


def _meetings(entries: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What _met says of whole entries, given by key, fold and node."""
    key, node, fold = (np.concatenate([e.column(i).to_numpy() for e in entries]) for i in range(3))
    start = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    n = np.diff(np.append(start, len(key)))
    pairs = [np.zeros((2, 0), np.int64)]
    for m in range(2, SMALL + 1):
        i, j = np.triu_indices(m, 1)
        first = start[n == m][:, None]
        a, b = (first + i).ravel(), (first + j).ravel()
        like = np.bitwise_count(fold[a] ^ fold[b]) <= HAMMING
        pairs.append(np.stack([node[a[like]], node[b[like]]]))
    found = [*_pair_rows(np.concatenate(pairs, axis=1))]
    for e in np.flatnonzero(n > SMALL).tolist():
        own = slice(start[e], start[e] + n[e])
        found += _large_entry(int(key[start[e]]), node[own], fold[own])
    if found:
        yield from pa.Table.from_batches(found).combine_chunks().to_batches(max_chunksize=1 << 16)


def _large_entry(key: int, node: np.ndarray, fold: np.ndarray) -> Iterator[pa.RecordBatch]:
    """What _met says of one entry, given by fold: pairs while they are no more than its rows, else buckets of like folds that chain together."""
    at = np.flatnonzero(np.append(True, fold[1:] != fold[:-1]))
    some, size = fold[at], np.diff(np.append(at, len(fold)))
    label, met, total = np.arange(len(some)), [], 0
    for g in range(0, len(some), 64):
        i, j = np.nonzero(np.bitwise_count(some[g : g + 64, None] ^ some[None, g:]) <= HAMMING)
        one, two = i[i <= j] + g, j[i <= j] + g
        for k in np.unique(one[label[one] != label[two]]).tolist():
            chained = label[two[slice(*np.searchsorted(one, [k, k + 1]))]]  # k's own among them
            hit = np.zeros(len(some), bool)
            hit[chained] = True
            label[hit[label]] = chained.min()
        keep = (one < two) | (size[one] <= SMALL)  # members of one fold that are many are a bucket
        one, two = one[keep], two[keep]
        total += int(np.where(one < two, size[one] * size[two], size[one] * (size[one] - 1) // 2).sum())
        if total <= len(node):
            met.append((one, two))
    if total <= len(node):
        one, two = (np.concatenate(x) for x in zip(*met, strict=True))
        cells = size[one] * size[two]
        i, j = np.divmod(_stepped(np.zeros(len(one), np.int64), cells), np.repeat(size[two], cells))
        one, two = np.repeat(one, cells), np.repeat(two, cells)
        keep = (one < two) | (i < j)
        yield from _pair_rows(np.stack([node[at[one] + i], node[at[two] + j]])[:, keep])
        label = np.where(size > SMALL, np.arange(len(some)), -1)
    of = np.repeat(label, size)
    for k in np.unique(label[label >= 0]).tolist():
        both = np.unique(node[of == k])
        if len(both) > 1:
            bucket = np.full(len(both), key << 32 | int(some[k]) & 0xFFFFFFFF)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(both), pa.nulls(len(both), pa.int64())], names=["bucket", "a", "b"])


def _pair_rows(pairs: np.ndarray) -> Iterator[pa.RecordBatch]:
    a, b = np.minimum(*pairs), np.maximum(*pairs)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = (a != b) & np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[: len(a)]
    for k in range(0, int(new.sum()), 1 << 16):
        x, y = a[new][k : k + (1 << 16)], b[new][k : k + (1 << 16)]
        yield pa.RecordBatch.from_arrays([pa.nulls(len(x), pa.int64()), pa.array(x), pa.array(y)], names=["bucket", "a", "b"])


def copy_classes(images: DataFrame) -> DataFrame:
    """media_id, class_id, n_corners for every row of images (media_id, image).

    class_id is the smallest media_id of those that links connect; images of the same pixels are one node. Null,
    empty and unreadable images are a class of their own, as are images without corners, unless their pixels
    are the same. Pairs meet by a table entry with like descriptors; where many images hold one of these,
    the pairs that are linked through others already are left out, all others are compared.
    """
    described = stored(_described(images), "corners")
    readable = described.where("digest IS NOT NULL")
    heads = stored(readable.groupBy("digest").agg(F.min("media_id").alias("media_id"), F.min("node").alias("node"), F.count("*").alias("n")), "heads")
    # Rows with the pixels of an earlier one are few or many; descriptors of the rest are read where they lie.
    again = stored(readable.select("digest", F.col("node").alias("other")).join(heads.where("n > 1"), "digest").where("other <> node").select(F.col("other").alias("node")), "again")
    nodes = readable.select("node", "corners", "bits").join(again, "node", "left_anti")
    met = stored(_met(nodes), "met")
    pairs = met.where("bucket IS NULL").select("a", "b")
    large = stored(one_of_equal(met.where("bucket IS NOT NULL").select("bucket", F.col("a").alias("node")).distinct()), "large")
    pivots, starred = stars(large, large.groupBy("node").agg(F.count("*").alias("rank")))
    links = stored(_linked(pairs.unionByName(starred).distinct(), nodes), "links")
    if not large.isEmpty():
        links = links.unionByName(stored(_across(large, pivots, components(links), nodes), "links"))
    groups = components(links)
    whole = heads.select("digest", "media_id", "node").join(groups, "node", "left").select("digest", "media_id", F.coalesce("component", "node").alias("component"))
    named = whole.groupBy("component").agg(F.min("media_id").alias("class_id"))
    classes = whole.join(named, "component").select("digest", "class_id")
    out = described.select("media_id", "digest", (F.octet_length("corners") / 16).cast("int").alias("n_corners")).join(classes, "digest", "left")
    return out.select("media_id", F.when(F.col("digest").isNull(), F.col("media_id")).otherwise(F.col("class_id")).alias("class_id"), "n_corners")


def _linked(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those pairs (a, b) of nodes whose corners agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = sum(pc.binary_length(batch[c]).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("ca", "cb"))
            for p, q in _cuts(size, 8 << 20):  # pictures of many corners come a few at a time
                part = batch.slice(p, q - p)
                yield part.filter(pa.array(agreeing_rows(part))).select(["a", "b"])

    a, b = (nodes.select(F.col("node").alias(x), F.col("corners").alias(f"c{x}"), F.col("bits").alias(f"b{x}")) for x in "ab")
    return pairs.join(a, "a").join(b, "b").select("a", "b", "ca", "ba", "cb", "bb").mapInArrow(run, "a long, b long")


def _across(large: DataFrame, pivots: DataFrame, groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """Links (a, b) that join different components within an entry: no two linked members stay apart."""
    met = tiles(large, pivots, groups, nodes.select("node", F.octet_length("bits").alias("size")), BLOCK, nodes.select("node", "corners", "bits"))

    def compare(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("node")
        nodes = rows.column("node").to_pylist()
        corners = [_corners(x) for x in rows.column("corners").to_pylist()]
        bits = [np.frombuffer(x, np.uint32).reshape(-1, WORDS) for x in rows.column("bits").to_pylist()]
        label = np.unique(rows.column("component").to_numpy(), return_inverse=True)[1]
        found = _joining(corners, bits, label, rows.column("block").to_numpy() == key[2].as_py(), key[1] == key[2])
        release_memory()
        return pa.table({"a": pa.array([nodes[i] for i, _ in found], pa.int64()), "b": pa.array([nodes[j] for _, j in found], pa.int64())})

    return met.groupBy("bucket", "x", "y").applyInArrow(compare, "a long, b long")


def _joining(corners: list[np.ndarray], bits: list[np.ndarray], label: np.ndarray, left: np.ndarray, within: bool) -> list[tuple[int, int]]:
    """Pairs of agreeing images that join two labels; each of `left` against all if `within`, else against the others."""
    label, found = label.copy(), []
    size = np.array([len(b) for b in bits])
    flat = np.concatenate(bits)
    for i in np.flatnonzero(left & (size >= AGREE)).tolist():
        open_ = (label != label[i]) & (size >= AGREE) & (np.arange(len(bits)) > i if within else ~left)
        if not open_.any():
            continue
        some = np.flatnonzero(open_)
        other = np.asfortranarray(flat[np.repeat(open_, size)])
        first = np.cumsum(size[some]) - size[some]
        of_i, of_j = np.zeros(len(some), np.int64), np.zeros(len(other), bool)
        for a in range(0, len(bits[i]), 16):
            like = _apart(bits[i][a : a + 16, None], other[None]) <= HAMMING
            of_i += np.logical_or.reduceat(like, first, axis=1).sum(axis=0)
            of_j |= like.any(axis=0)
        enough = (of_i >= AGREE) & (np.add.reduceat(of_j, first, dtype=np.int64) >= AGREE)
        for j in some[enough].tolist():
            if label[j] != label[i] and agreeing((corners[i], bits[i]), (corners[j], bits[j]), AGREE) >= AGREE:
                found.append((i, j))
                label[label == label[j]] = label[i]
    return found


#: Tiles of a preview: pixels of one, and tiles in a row.
TILE, ACROSS = 5, 16
#: Odd multipliers of a word's hash, one for each pixel of its tile.
SHADES = mix(np.arange(1, TILE * TILE + 1, dtype=np.uint64)) | np.uint64(1)


def page_text(html: str | Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags out."""
    text = F.regexp_replace(html, r"(?is)<(?:(script|style)\b.*?</\1\s*>|!--.*?-->)", " ")
    return F.regexp_replace(text, r"(?s)<[^>]*>", " ")


def previews(pages: DataFrame, text: str) -> DataFrame:
    """Adds image, a grey preview of a text as PGM: a tile of pixels for each word, in rows, shaded by the word's hash.

    The same words give the same tiles, so an excerpt of whole rows is a crop of the preview. Null or blank
    texts give null.
    """
    kept = pages.drop("image")
    at = kept.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows_by_bytes(batches, text, 1 << 20):
            images = _previews(batch.column(at).to_pylist())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(images, pa.binary())], names=[*batch.schema.names, "image"])

    return kept.mapInArrow(run, kept.withColumn("image", F.lit(None).cast("binary")).schema)


def _preview(text: str | None) -> bytes | None:
    return _previews([text])[0]


def _previews(texts: list[str | None]) -> list[bytes | None]:
    """The previews of several texts; all their words are hashed and shaded together."""
    words = [text.split() if text else [] for text in texts]
    n = np.array([len(w) for w in words], np.int64)
    if not n.any():
        return [None] * len(texts)
    data = np.frombuffer(" ".join(" ".join(w) for w in words if w).encode("utf-8", "replace"), np.uint8)
    gaps = np.flatnonzero(data == 32)
    rows = -(-n // ACROSS)
    first = np.cumsum(rows) - rows
    seed = np.zeros(int(rows.sum()) * ACROSS, np.uint64)  # tiles without a word stay black
    seed[np.arange(int(n.sum())) + np.repeat(first * ACROSS - np.cumsum(n) + n, n)] = ByteHash(data).slices(np.append(0, gaps + 1), np.append(gaps, len(data)))
    seed = seed.reshape(-1, ACROSS)
    pixels = np.empty((len(seed), TILE, ACROSS * TILE), np.uint8)
    shades = np.tile(SHADES.reshape(TILE, TILE), ACROSS)
    for a in range(0, len(seed), 256):
        wide = np.repeat(seed[a : a + 256], TILE, axis=1)
        for line in range(TILE):
            pixels[a : a + 256, line] = (wide * shades[line]) >> np.uint64(61)
    pixels *= np.uint8(36)
    pixels = pixels.reshape(-1, ACROSS * TILE)
    return [pgm(pixels[a * TILE : (a + r) * TILE]) if r else None for a, r in zip(first.tolist(), rows.tolist(), strict=True)]
