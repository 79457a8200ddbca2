"""Media columns: progressive JPEG decoded into coefficient arrays and RGB tensors.

The decoder reads a progressive stream scan by scan. Spectral selection puts a band of coefficients, successive
approximation one more bit of precision into integer arrays per component; after the last scan the arrays are
dequantised, inverse-transformed with numpy, the chroma planes are enlarged to full resolution, and the picture
becomes a tensor (height, width, 3) of 8-bit RGB. Scans whose code table holds one symbol have codes of equal
length and are read at once with array operations; others are read symbol by symbol.

The encoder stores bytes losslessly in a valid stream: a JPEG's unit is the coefficient, and size category eight
has exactly 256 values, so each byte is one coefficient of a 4:2:0 picture, sent as its upper seven bits and, in
refinement scans, its lowest.

Defined cases: a null or empty text is one padded payload; a stream that breaks off raises ValueError with the
document's position; equal payloads give equal streams.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from math import ceil

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .common import small_batches

#: Fixed values of the JPEG standard: the zig-zag order of an 8 x 8 block, built by walking its diagonals.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8) if (i // 8 + i % 8) % 2 else (i % 8))))
UNZIG = np.argsort(ZIGZAG)
_X = np.arange(8)
#: Rows u, columns x of the 8-point inverse cosine transform.
BASIS = (np.where(_X[:, None] == 0, np.sqrt(0.125), 0.5) * np.cos((2 * _X[None, :] + 1) * _X[:, None] * np.pi / 16)).astype(np.float32)
PAYLOAD_UNIT = 192
MCU_BYTES = 384
BANDS = ((1, 5), (6, 63))


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _one_symbol_table(table_class: int, symbol: int) -> bytes:
    """A code table whose only code, the bit 0, means ``symbol``."""
    return _segment(0xC4, bytes([table_class << 4, 1] + [0] * 15 + [symbol]))


def _scan_header(components, first: int, last: int, high: int, low: int) -> bytes:
    return _segment(0xDA, bytes([len(components)] + [b for c in components for b in (c, 0)] + [first, last, high << 4 | low]))


def _stuff(data: np.ndarray) -> bytes:
    """Entropy-coded bytes with a zero after each 255."""
    if not (data == 255).any():
        return data.tobytes()
    return data.tobytes().replace(b"\xff", b"\xff\x00")


def encode_payload(payload: bytes) -> bytes:
    """A progressive 4:2:0 stream whose coefficients are the payload's bytes (padded to whole units of 384)."""
    units = max(1, ceil(len(payload) / MCU_BYTES))
    wide = min(units, 64)
    tall = ceil(units / wide)
    raw = np.zeros(wide * tall * MCU_BYTES, np.uint8)
    raw[: len(payload)] = np.frombuffer(payload, np.uint8)
    n_y = wide * tall * 4 * 64
    planes = [raw[:n_y].reshape(-1, 64), raw[n_y : n_y + n_y // 4].reshape(-1, 64), raw[n_y + n_y // 4 :].reshape(-1, 64)]
    out = [b"\xff\xd8", _segment(0xFE, struct.pack(">I", len(payload))), _segment(0xDB, bytes([0] + [1] * 64))]
    out.append(_segment(0xC2, struct.pack(">BHHB", 8, tall * 16, wide * 16, 3) + bytes([1, 0x22, 0, 2, 0x11, 0, 3, 0x11, 0])))
    # First scans: seven bits a coefficient after the bit 0 of the only code.
    out += [_one_symbol_table(0, 7), _segment(0xDD, struct.pack(">H", 1))]
    for c, p in enumerate(planes, 1):
        n = len(p)
        dc = np.empty((n, 3), np.uint8)
        dc[:, 0], dc[:, 1], dc[:, 2] = p[:, 0] >> 1, 255, 0xD0 + np.arange(n) % 8
        out += [_scan_header([c], 0, 0, 0, 1), dc.tobytes()[:-2]]
    out += [_segment(0xDD, struct.pack(">H", 0)), _one_symbol_table(1, 7)]
    for first, last in BANDS:
        for c, p in enumerate(planes, 1):
            out += [_scan_header([c], first, last, 0, 1), (p[:, first : last + 1] >> 1).tobytes()]
    # Refinement scans: one bit a coefficient; a block of the band starts with the code for "no new coefficient".
    for c, p in enumerate(planes, 1):
        bits = p[:, 0] & 1
        pad = np.ones(-len(bits) % 8, np.uint8)
        out += [_scan_header([c], 0, 0, 1, 0), _stuff(np.packbits(np.concatenate([bits, pad])))]
    out.append(_one_symbol_table(1, 0))
    for c, p in enumerate(planes, 1):
        b = p & 1
        bits = np.where(p >= 128, b, 1 - b)
        bits[:, 0] = 0
        out += [_scan_header([c], 1, 63, 1, 0), _stuff(np.packbits(bits, axis=1).ravel())]
    out.append(b"\xff\xd9")
    return b"".join(out)


class _Component:
    def __init__(self, ident: int, h: int, v: int, table: int):
        self.id, self.h, self.v, self.table = ident, h, v, table


class _Bits:
    """Single bits and fields of one stretch of entropy-coded bytes."""

    def __init__(self, data: bytes):
        self.bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
        self.at = 0

    def take(self, n: int = 1) -> int:
        if self.at + n > len(self.bits):
            raise ValueError("the scan's data ends early")
        value = 0
        for b in self.bits[self.at : self.at + n]:
            value = value << 1 | b
        self.at += n
        return value

    def symbol(self, codes: dict[tuple[int, int], int]) -> int:
        code = 0
        for n in range(1, 17):
            code = code << 1 | self.take()
            if (n, code) in codes:
                return codes[n, code]
        raise ValueError("no such code")


def _signed(bits: int, size: int) -> int:
    return bits if size == 0 or bits >> (size - 1) else bits - (1 << size) + 1


class ProgressiveDecoder:
    """Accumulates the scans of one stream; ``coefficients`` holds a (blocks down, blocks across, 64) array each."""

    def __init__(self, data: bytes):
        self.data, self.quant, self.codes, self.restart = data, {}, {}, 0
        self.components: list[_Component] = []
        self.comments: list[bytes] = []
        self.coefficients: dict[int, np.ndarray] = {}
        self._read()

    def _read(self):
        d, at = self.data, 2
        if d[:2] != b"\xff\xd8":
            raise ValueError("not a JPEG stream")
        while True:
            if at + 2 > len(d) or d[at] != 0xFF:
                raise ValueError(f"no marker at byte {at}")
            marker = d[at + 1]
            if marker == 0xD9:
                return
            size = struct.unpack_from(">H", d, at + 2)[0]
            body = d[at + 4 : at + 2 + size]
            at += 2 + size
            if marker == 0xDB:
                self._tables_of_quantisation(body)
            elif marker == 0xC4:
                self._tables_of_codes(body)
            elif marker == 0xDD:
                self.restart = struct.unpack(">H", body)[0]
            elif marker == 0xFE:
                self.comments.append(body)
            elif marker == 0xC2:
                self._frame(body)
            elif 0xC0 <= marker <= 0xCF:
                raise ValueError("only progressive streams of Huffman codes are read")
            elif marker == 0xDA:
                at = self._scan(body, at)

    def _tables_of_quantisation(self, body: bytes):
        at = 0
        while at < len(body):
            wide, ident = body[at] >> 4, body[at] & 15
            n = 128 if wide else 64
            self.quant[ident] = np.frombuffer(body[at + 1 : at + 1 + n], ">u2" if wide else "u1").astype(np.int32)
            at += 1 + n

    def _tables_of_codes(self, body: bytes):
        at = 0
        while at < len(body):
            key, lengths = (body[at] >> 4, body[at] & 15), body[at + 1 : at + 17]
            symbols, at = body[at + 17 : at + 17 + sum(lengths)], at + 17 + sum(lengths)
            codes, code, i = {}, 0, 0
            for n, count in enumerate(lengths, 1):
                for _ in range(count):
                    codes[n, code] = symbols[i]
                    code, i = code + 1, i + 1
                code <<= 1
            self.codes[key] = codes

    def _frame(self, body: bytes):
        _, self.height, self.width, n = struct.unpack(">BHHB", body[:6])
        self.components = [_Component(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        self.h_max, self.v_max = max(c.h for c in self.components), max(c.v for c in self.components)
        self.mcus = (ceil(self.height / (8 * self.v_max)), ceil(self.width / (8 * self.h_max)))
        for c in self.components:
            self.coefficients[c.id] = np.zeros((self.mcus[0] * c.v, self.mcus[1] * c.h, 64), np.int32)

    def _scan(self, body: bytes, at: int) -> int:
        """Reads one scan's data from byte ``at``; returns where the next marker is."""
        n = body[0]
        chosen = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(n)}
        comps = [c for c in self.components if c.id in chosen]
        first, last, high, low = body[1 + 2 * n], body[2 + 2 * n], body[3 + 2 * n] >> 4, body[3 + 2 * n] & 15
        if n == 1:
            c = comps[0]
            down = ceil(ceil(self.height * c.v / self.v_max) / 8)
            across = ceil(ceil(self.width * c.h / self.h_max) / 8)
            grid = self.coefficients[c.id][:down, :across]
            whole = grid.shape == self.coefficients[c.id].shape
            done = self._fast(c, grid, chosen[c.id], first, last, high, low, at) if whole else None
            if done is not None:
                return done
            units = [[(c, y, x)] for y in range(down) for x in range(across)]
        else:
            units = [[(c, my * c.v + v, mx * c.h + h) for c in comps for v in range(c.v) for h in range(c.h)] for my in range(self.mcus[0]) for mx in range(self.mcus[1])]
        end = at
        while end + 1 < len(self.data) and (self.data[end] != 0xFF or self.data[end + 1] == 0 or 0xD0 <= self.data[end + 1] <= 0xD7):
            end += 1 + (self.data[end] == 0xFF)
        stretches = self._stretches(self.data[at:end])
        step = self.restart or len(units)
        for i in range(0, len(units), step):
            bits, state = _Bits(stretches[i // step]), {"eob": 0}
            for unit in units[i : i + step]:
                for c, y, x in unit:
                    self._block(bits, state, c, self.coefficients[c.id][y, x], chosen[c.id], first, last, high, low)
        return end

    @staticmethod
    def _stretches(data: bytes) -> list[bytes]:
        out, start, i = [], 0, 0
        while (i := data.find(b"\xff", i)) >= 0:
            if i + 1 < len(data) and 0xD0 <= data[i + 1] <= 0xD7:
                out.append(data[start:i])
                start = i + 2
            i += 2
        return [x.replace(b"\xff\x00", b"\xff") for x in [*out, data[start:]]]

    def _fast(self, c, grid, tables, first, last, high, low, at):
        """The whole scan with array operations, if its only code makes all fields equally long; else None."""
        dc, ac = self.codes.get((0, tables >> 4), {}), self.codes.get((1, tables & 15), {})
        n, d = grid.shape[0] * grid.shape[1], self.data
        flat = grid.reshape(n, 64)
        codes = dc if first == 0 else ac
        if not (high and first == 0) and (len(codes) != 1 or (1, 0) not in codes):
            return None
        if high == 0 and first == 0:
            size = dc[1, 0]
            if size != 7 or self.restart != 1:
                return None
            got = np.frombuffer(d, np.uint8, 3 * n - 2, at)[::3].astype(np.int32)
            flat[:, 0] = np.where(got & 64, got, got - 127) << low
            return at + 3 * n - 2
        if self.restart:
            return None
        if high == 0:
            if ac[1, 0] != 7:
                return None
            width = last - first + 1
            got = np.frombuffer(d, np.uint8, n * width, at).reshape(n, width).astype(np.int32)
            flat[:, first : last + 1] = np.where(got & 64, got, got - 127) * (1 << low)
            return at + n * width
        if first == 0:
            raw, end = self._unstuffed(at, (n + 7) // 8)
            flat[:, 0] |= np.unpackbits(raw)[:n].astype(np.int32) << low
            return end
        band = flat[:, first : last + 1]
        if ac[1, 0] != 0 or (last - first + 2) % 8 or not band.all():
            return None
        raw, end = self._unstuffed(at, n * (last - first + 2) // 8)
        bits = np.unpackbits(raw).reshape(n, last - first + 2)[:, 1:].astype(np.int32) << low
        band += np.where(band > 0, bits, -bits)
        return end

    def _unstuffed(self, at: int, want: int) -> tuple[np.ndarray, int]:
        """``want`` data bytes from ``at`` on and the place after them."""
        end = self.data.find(b"\xff", at)
        while self.data[end + 1] == 0:
            end = self.data.find(b"\xff", end + 2)
        raw = self.data[at:end].replace(b"\xff\x00", b"\xff")
        if len(raw) != want:
            raise ValueError("the scan's data has another length")
        return np.frombuffer(raw, np.uint8), end

    def _block(self, bits, state, c, block, tables, first, last, high, low):
        """One block of one scan, symbol by symbol."""
        if first == 0:
            if high:
                block[0] |= bits.take() << low
                return
            size = bits.symbol(self.codes[0, tables >> 4])
            state[c.id] = state.get(c.id, 0) + _signed(bits.take(size) if size else 0, size)
            block[0] = state[c.id] << low
            return
        codes, k, one = self.codes[1, tables & 15], first, 1 << low
        if not high:
            if state["eob"]:
                state["eob"] -= 1
                return
            while k <= last:
                run, size = divmod(bits.symbol(codes), 16)
                if size:
                    k += run
                    block[k] = _signed(bits.take(size), size) * one
                    k += 1
                elif run == 15:
                    k += 16
                else:
                    state["eob"] = (1 << run) + (bits.take(run) if run else 0) - 1
                    return
            return

        def correct(k):
            if bits.take():
                block[k] += one if block[k] > 0 else -one

        if not state["eob"]:
            while k <= last:
                run, size = divmod(bits.symbol(codes), 16)
                if size == 0 and run < 15:
                    state["eob"] = (1 << run) + (bits.take(run) if run else 0)
                    break
                new = (one if bits.take() else -one) if size else 0
                while k <= last:
                    if block[k]:
                        correct(k)
                    elif run == 0:
                        break
                    else:
                        run -= 1
                    k += 1
                if new and k <= last:
                    block[k] = new
                k += 1
        if state["eob"]:
            for j in range(k, last + 1):
                if block[j]:
                    correct(j)
            state["eob"] -= 1

    def planes(self) -> list[np.ndarray]:
        """Each component's samples by dequantising and the inverse transform."""
        out = []
        for c in self.components:
            rows, cols, _ = self.coefficients[c.id].shape
            freq = (self.coefficients[c.id] * self.quant[c.table]).astype(np.float32)[..., UNZIG].reshape(-1, 8, 8)
            px = (BASIS.T @ freq @ BASIS).reshape(rows, cols, 8, 8).transpose(0, 2, 1, 3).reshape(rows * 8, cols * 8)
            out.append(px + np.float32(128))
        return out

    def rgb(self) -> np.ndarray:
        """The full-resolution tensor; chroma samples are repeated over the pixels they cover."""
        full = []
        for c, p in zip(self.components, self.planes()):
            p = np.repeat(np.repeat(p, self.v_max // c.v, axis=0), self.h_max // c.h, axis=1)
            full.append(p[: self.height, : self.width])
        if len(full) == 1:
            full *= 3
            y, cb, cr = full[0], np.float32(128), np.float32(128)
        else:
            y, cb, cr = full
        out = np.empty((self.height, self.width, 3), np.uint8)
        for i, plane in enumerate((y + np.float32(1.402) * (cr - 128), y - np.float32(0.344136) * (cb - 128) - np.float32(0.714136) * (cr - 128), y + np.float32(1.772) * (cb - 128))):
            out[..., i] = np.clip(np.rint(plane), 0, 255)
        return out

    def payload(self) -> bytes:
        """The bytes that ``encode_payload`` stored, from the coefficient arrays."""
        parts = []
        for c in self.components:
            v = self.coefficients[c.id].reshape(-1, 64)
            b = np.where(v > 0, v, v + 255)
            b[:, 0] = np.where(v[:, 0] > 0, v[:, 0], v[:, 0] + 254)
            parts.append(b.astype(np.uint8).ravel())
        size = struct.unpack(">I", self.comments[0])[0]
        return np.concatenate(parts).tobytes()[:size]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "replace")
    want = max(1, ceil(len(raw) / PAYLOAD_UNIT)) * PAYLOAD_UNIT
    return len(raw), raw.ljust(want, b" ")


def encode_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, media: each text's stream in a binary column."""
    small_batches(docs.sparkSession)

    def run(batches):
        for b in batches:
            got = [padded(t) for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": [n for n, _ in got], "media": [encode_payload(p) for _, p in got]})

    kind = dict(docs.dtypes)[id_col]
    return docs.selectExpr(f"`{id_col}` as doc_id", f"`{text_col}` as text").mapInPandas(run, f"doc_id {kind}, n_bytes long, media binary")


def tensors(media: DataFrame, media_col: str = "media") -> DataFrame:
    """Adds nothing but the decoded picture: doc_id, height, width, rgb (row-major bytes of the uint8 tensor)."""

    def run(batches):
        for b in batches:
            for i, m in zip(b["doc_id"], b["media"]):
                t = ProgressiveDecoder(bytes(m)).rgb()
                yield pd.DataFrame({"doc_id": [i], "height": [t.shape[0]], "width": [t.shape[1]], "rgb": [t.tobytes()]})

    return media.selectExpr("doc_id", f"`{media_col}` as media").mapInPandas(run, f"doc_id {dict(media.dtypes)['doc_id']}, height int, width int, rgb binary")


def describe(media: DataFrame) -> DataFrame:
    """Digests and features read from the stored streams: payload from the coefficients, colours, shape and digest of the
    full-resolution tensor."""

    def run(batches):
        for b in batches:
            out = []
            for m in b["media"]:
                m = bytes(m)
                pic = ProgressiveDecoder(m)
                payload, t = pic.payload(), pic.rgb()
                flat = t.reshape(-1, 3)
                mean = flat.mean(axis=0, dtype=np.float64)
                feature = f"{pic.width}x{pic.height} rgb " + " ".join(f"{x:.3f}" for x in mean)
                out.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(m), hashlib.sha256(m).hexdigest(), feature, "x".join(map(str, t.shape)), hashlib.sha256(t).hexdigest()))
            cols = list(zip(*out)) or [[]] * 8
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_bytes": b["n_bytes"], "payload_bytes": cols[0], "payload_sha256": cols[1], "tail_crc32": cols[2], "media_bytes": cols[3], "media_sha256": cols[4], "feature": cols[5], "tensor_shape": cols[6], "tensor_sha256": cols[7]})

    kind = dict(media.dtypes)["doc_id"]
    return media.select("doc_id", "n_bytes", "media").mapInPandas(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tensor_shape string, tensor_sha256 string")
