"""Secret scans: a worklist of decoded layers, each rescanned and mapped back to the source.

The worklist starts with the text itself. From each layer it derives further ones: the layer with
all its percent escapes decoded, with all its backslash and HTML character escapes decoded, and,
for each long base64 token, in one line or wrapped over several, that token's decoded bytes,
decompressed where they carry the mark of gzip, zlib, bzip2 or xz (again until they don't). The
bytes that escapes stand for are decompressed too. Bytes that aren't UTF-8 are read as Latin-1, and
once more with the runs of two or four bytes a letter (UTF-16, UTF-32) narrowed. A layer joins the list only if the pair of its
content and its place has not been seen, so chains that return to an earlier layer end, and the
list runs dry at the fixpoint. Every layer keeps, for each of its characters, the range of source
characters it came from; a match in a layer is reported as the smallest source range that covers it.

Nulls and empty texts have no spans. Texts are scanned whole. Repeated rows give repeated results.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from samefold.llm.common import arrow_map, documents

#: Kinds in the order in which spans with one start are listed.
KINDS = ("assign", "access", "hex")
#: What the base scan looks for.
ASSIGN = re.compile(
    r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.A
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
_KEYWORD = re.compile(r"passw|secret|token|api_?key", re.A | re.I)

_PERCENT = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_ESCAPE = re.compile(
    r"\\u\{([0-9A-Fa-f]{1,6})\}|\\u([0-9A-Fa-f]{4})|\\U([0-9A-Fa-f]{8})|\\x([0-9A-Fa-f]{2})|&#x([0-9A-Fa-f]{1,6});|&#([0-9]{1,7});"
)
_BASE64 = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Base64 over several lines; its first line may hold little of it.
_WRAPPED = re.compile(
    r"(?<![A-Za-z0-9+/_-])(?:[A-Za-z0-9+/_-]{16,}+|[A-Za-z0-9+/_-]++(?=[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]{16}))"
    r"(?:[\x20\t]*+\r?\n[\x20\t]*+[A-Za-z0-9+/_-]++)++={0,2}"
)
_GAP = re.compile(r"[\x20\t\r\n]+")
#: Letters of four or two bytes, of which all but one are 0.
_WIDE = re.compile(rb"(?:[\x01-\xff]\0\0\0){4,}|(?:\0\0\0[\x01-\xff]){4,}|(?:[\x01-\xff]\0){4,}|(?:\0[\x01-\xff]){4,}")
#: One byte as an escape, and the marks of compression among decoded bytes.
_BYTE = re.compile(r"%([0-9A-Fa-f]{2})|\\x([0-9A-Fa-f]{2})|\\u00([0-9A-Fa-f]{2})|\\u\{0{0,4}([0-9A-Fa-f]{1,2})\}|&#x0{0,4}([0-9A-Fa-f]{1,2});|&#([0-9]{1,3});|\\([0abfnrtv\\'\"])")
_SIMPLE = dict(zip("0abfnrtv\\'\"", "\0\a\b\f\n\r\t\v\\'\"", strict=True))
_MARK = re.compile(r"\x1f\x8b\x08|BZh[1-9]1AY&SY|\xfd7zXZ\0|[\x08\x18\x28\x38\x48\x58\x68\x78][\0-\xff]")
_NOT_BYTE = re.compile(r"[^\0-\xff]")
#: What unpacks to more bytes than this is scanned in windows, each of which begins with the last OVERLAP
#: bytes of the one before. All that is found in such a layer maps to the whole token, so the windows find
#: what the whole would; only an encoded token longer than OVERLAP may be cut inside it.
MAX_UNPACKED, OVERLAP = 64 << 20, 1 << 20


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost, non-overlapping matches of each kind that pass its length test."""
    found = []
    if _KEYWORD.search(text):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return found


def listed(spans) -> str:
    order = sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))
    return ",".join(f"{k}:{a}:{b}" for k, a, b in order)


class Layer:
    """A decoded text and the source range of each of its pieces.

    A piece is (start in the layer, source start, source end, linear): the characters of a linear
    piece map one to one; all characters of another piece map to its whole source range."""

    def __init__(self, text: str, pieces: list[tuple[int, int, int, bool]], how: tuple[str, ...]):
        self.text, self.pieces, self.how = text, pieces, how
        self.starts = [p[0] for p in pieces]

    def source(self, start: int, end: int) -> tuple[int, int]:
        first = self.pieces[bisect_right(self.starts, start) - 1]
        last = self.pieces[bisect_right(self.starts, end - 1) - 1]
        a = first[1] + (start - first[0] if first[3] else 0)
        b = last[1] + (end - last[0]) if last[3] else last[2]
        return a, b

    def key(self) -> tuple[bytes, int, int]:
        ends = self.source(0, max(1, len(self.text)))
        return hashlib.blake2b(self.text.encode("utf-8", "surrogatepass"), digest_size=16).digest(), *ends


def _replaced(layer: Layer, pattern: re.Pattern, decode) -> tuple[str, list] | None:
    """The layer with every match of pattern replaced by decode(match), where that isn't None."""
    text, out, pieces, at, size, changed = layer.text, [], [], 0, 0, False

    def keep(a: int, b: int) -> None:
        nonlocal size
        while a < b:  # copy the layer's own pieces
            k = bisect_right(layer.starts, a) - 1
            stop = min(b, layer.starts[k + 1] if k + 1 < len(layer.starts) else b)
            s0, src_a, src_b, linear = layer.pieces[k]
            pieces.append((size, src_a + (a - s0), src_b, True) if linear else (size, src_a, src_b, False))
            out.append(text[a:stop])
            size += stop - a
            a = stop

    for m in pattern.finditer(text):
        parts = decode(m)
        if parts is None:
            continue
        keep(at, m.start())
        for piece, a, b in parts:
            pieces.append((size, *layer.source(m.start() + a, m.start() + b), False))
            out.append(piece)
            size += len(piece)
        at, changed = m.end(), True
    if not changed:
        return None
    keep(at, len(text))
    return "".join(out), pieces


def _percent(m: re.Match):
    raw = bytes.fromhex(m[0].replace("%", ""))
    try:
        chars = raw.decode()
    except UnicodeDecodeError:
        chars = raw.decode("latin-1")
        return [(c, 3 * i, 3 * i + 3) for i, c in enumerate(chars)]
    parts, at = [], 0
    for c in chars:
        n = 3 * len(c.encode())
        parts.append((c, at, at + n))
        at += n
    return parts


def _escape(m: re.Match):
    *hexes, decimal = m.groups()
    code = int(decimal) if decimal is not None else int(next(x for x in hexes if x is not None), 16)
    if code > 0x10FFFF or 0xD800 <= code < 0xE000:
        return None
    return [(chr(code), 0, len(m[0]))]


def _unpacker(raw: bytes):
    if raw[:2] == b"\x1f\x8b":
        return zlib.decompressobj(31)
    if len(raw) > 2 and raw[0] & 15 == 8 and raw[0] >> 4 <= 7 and (raw[0] << 8 | raw[1]) % 31 == 0:
        return zlib.decompressobj()
    if raw[:3] == b"BZh":
        return bz2.BZ2Decompressor()
    return lzma.LZMADecompressor() if raw[:6] == b"\xfd7zXZ\x00" else None


class _Large(Exception):
    """It unpacks to over MAX_UNPACKED bytes."""


def _inflating(parts: Iterator[bytes]) -> Iterator[bytes]:
    """One compression layer less of a stream of bytes, in parts of bounded size; its end where the
    streams in it end or break."""
    held, unpack, step = b"", None, 1 << 20
    for part in parts:
        held += part
        while held:
            if unpack is None:
                if len(held) < 6:
                    break
                unpack = _unpacker(held[:6])
                if unpack is None:
                    return
            try:
                yield unpack.decompress(held, step)
                if hasattr(unpack, "unconsumed_tail"):
                    held = unpack.unconsumed_tail
                else:
                    held = b""
                    while not unpack.eof and not unpack.needs_input:
                        yield unpack.decompress(b"", step)
            except (zlib.error, OSError, lzma.LZMAError, EOFError):
                return
            if unpack.eof:
                held, unpack = unpack.unused_data, None


def _windows(raw: bytes) -> Iterator[bytes]:
    """All that raw unpacks to, through every layer, in windows."""
    parts, layered = iter([raw]), True
    while layered:
        head = b""
        for part in parts:
            head += part
            if len(head) >= 6:
                break
        layered = _unpacker(head[:6]) is not None
        parts = _inflating(chain([head], parts)) if layered else chain([head], parts)
    window: list[bytes] = []
    size = 0
    for part in parts:
        window.append(part)
        size += len(part)
        if size >= MAX_UNPACKED:
            whole = b"".join(window)
            yield whole
            window = [whole[-OVERLAP:]]
            size = len(window[0])
    if window:
        yield b"".join(window)


def _unpacked(raw: bytes) -> Iterator[tuple[bytes, int]]:
    """What raw is after all its compression layers, and how many there were; in windows if it is large."""
    packed, n = raw, 0
    try:
        while (more := _inflated(packed)) is not None:
            packed, n = more[0], n + 1
    except _Large:
        for window in _windows(raw):
            yield window, max(n, 1)
        return
    yield packed, n


def _inflated(raw: bytes) -> tuple[bytes, int] | None:
    """One compression layer less and the bytes it took, all streams that follow one another
    together, or None if there is none. _Large if it is beyond MAX_UNPACKED."""
    out, size, at = [], 0, 0
    while (unpack := _unpacker(raw[at : at + 6])) is not None:
        end, step = at, 4096
        try:
            while not unpack.eof and end < len(raw):  # in growing pieces: what is no stream ends early
                part = unpack.decompress(raw[end : end + step], MAX_UNPACKED - size + 1)
                out.append(part)
                size += len(part)
                if size > MAX_UNPACKED:
                    raise _Large
                end, step = min(len(raw), end + step), step * 2
        except (zlib.error, OSError, lzma.LZMAError, EOFError):
            break
        if not unpack.eof:
            break
        at, whole = end - len(unpack.unused_data), len(out)
    return (b"".join(out[:whole]), at) if at else None


def _texts(raw: bytes) -> list[tuple[str, list[int]]]:
    """What bytes may say: texts, and where each character begins (and the last one ends)."""
    if not raw:
        return []
    try:
        text, at = raw.decode(), [0]
        for c in text:
            at.append(at[-1] + len(c.encode()))
    except UnicodeDecodeError:
        text, at = raw.decode("latin-1"), list(range(len(raw) + 1))
    found = [(text, at)]
    if b"\0" in raw and _WIDE.search(raw):
        out, at, end = [], [], 0
        for m in _WIDE.finditer(raw):
            letters = m[0].replace(b"\0", b"")
            out += [raw[end : m.start()], letters]
            at += [*range(end, m.start()), *range(m.start(), m.end(), len(m[0]) // len(letters))]
            end = m.end()
        found.append((b"".join([*out, raw[end:]]).decode("latin-1"), [*at, *range(end, len(raw) + 1)]))
    return found


def _tokens(layer: Layer):
    """Decoded base64 tokens of a layer, through any compression: (text, pieces, how)."""
    tokens = [(m, False) for m in _BASE64.finditer(layer.text)]
    if "\n" in layer.text:
        tokens += [(m, True) for m in _WRAPPED.finditer(layer.text)]
    for m, wrapped in tokens:
        body, place = m[0].rstrip("="), None  # place: of each character of body in m[0]
        if wrapped:
            place, end = [], 0
            for gap in _GAP.finditer(body):
                place += range(end, gap.start())
                end = gap.end()
            place += range(end, len(body))
            body = _GAP.sub("", body)
        body = body.replace("-", "+").replace("_", "/")
        if len(body) % 4 == 1:
            if not wrapped:
                continue
            body = body[:-1]  # the last line may run into other words
        try:
            raw = base64.b64decode(body + "=" * (-len(body) % 4))
        except (binascii.Error, ValueError):
            continue
        end = len(m[0])
        try:
            used = _inflated(raw) if wrapped else None
        except _Large:
            used = None
        if used is not None and (quads := -(-used[1] // 3) * 4) < len(body):
            if place[quads - 1] < _GAP.search(m[0]).start():
                continue  # it ends in the first line, a token of its own
            end = place[quads - 1] + 1
        for packed, n in _unpacked(raw):
            how = ("base64", *["compressed"] * n)
            for text, at in _texts(packed):
                if n:
                    pieces = [(0, *layer.source(m.start(), m.start() + end), False)]
                else:  # three bytes for four characters: a character maps to the quads its bytes lie in
                    pieces = []
                    for i in range(len(text)):
                        a, b = at[i] // 3 * 4, -(-at[i + 1] // 3) * 4
                        if place is None:
                            b = min(len(m[0]), b)
                        else:
                            a, b = place[a], place[min(b, len(place)) - 1] + 1
                        pieces.append((i, *layer.source(m.start() + a, m.start() + b), False))
                yield text, pieces, how


def _byte(m: re.Match):
    *hexes, decimal, simple = m.groups()
    if simple is not None:
        return [(_SIMPLE[simple], 0, len(m[0]))]
    code = int(decimal) if decimal is not None else int(next(x for x in hexes if x is not None), 16)
    return [(chr(code), 0, len(m[0]))] if code < 256 else None


def _packed(layer: Layer):
    """Compressed streams in the bytes that a layer's escapes stand for: (text, pieces, how)."""
    if (new := _replaced(layer, _BYTE, _byte)) is None:
        return
    data, at = Layer(*new, ()), 0
    while (m := _MARK.search(data.text, at)) is not None:
        at = m.start() + 1
        if len(m[0]) == 2 and (ord(m[0][0]) << 8 | ord(m[0][1])) % 31:
            continue
        stop = _NOT_BYTE.search(data.text, m.start())
        end = stop.start() if stop else len(data.text)
        # a failed try must not copy the whole rest: the first bytes show whether it is a stream
        try:
            _unpacker(data.text[m.start() : m.start() + 6].encode("latin-1")).decompress(data.text[m.start() : min(end, m.start() + 512)].encode("latin-1"), 1 << 16)
        except (zlib.error, OSError, lzma.LZMAError, EOFError, AttributeError):
            continue
        raw = data.text[m.start() : end].encode("latin-1")
        try:
            more = _inflated(raw)
        except _Large:
            more = b"", len(raw)
        if more is None:
            continue
        source = data.source(m.start(), m.start() + more[1])
        at = m.start() + more[1]
        for packed, n in _unpacked(raw[: more[1]]):
            for text, _ in _texts(packed):
                yield text, [(0, *source, False)], ("escape", *["compressed"] * n)


def layers(text: str):
    """The text and every layer under it, in the order of the worklist."""
    todo, seen = [Layer(text, [(0, 0, len(text), True)], ())], set()
    while todo:
        layer = todo.pop()
        if not layer.text or (key := layer.key()) in seen:
            continue
        seen.add(key)
        yield layer
        if "%" in layer.text and (new := _replaced(layer, _PERCENT, _percent)):
            todo.append(Layer(*new, (*layer.how, "url")))
        if ("\\" in layer.text or "&#" in layer.text) and (new := _replaced(layer, _ESCAPE, _escape)):
            todo.append(Layer(*new, (*layer.how, "unicode")))
        todo += [Layer(t, p, (*layer.how, *how)) for t, p, how in _tokens(layer)]
        if "%" in layer.text or "\\" in layer.text or "&#" in layer.text:
            todo += [Layer(t, p, (*layer.how, *how)) for t, p, how in _packed(layer)]


def encoded(text: str) -> bool:
    """Whether any layer may lie under the text."""
    return bool("%" in text or "\\" in text or "&#" in text or _BASE64.search(text) or "\n" in text and _WRAPPED.search(text))


def scan(text: str | None) -> tuple[list[tuple[str, int, int]], set[tuple[str, int, int]], int]:
    """Base spans, all spans, and the number of layers of a text."""
    if not text:
        return [], set(), 0
    base = base_spans(text)
    if not encoded(text):
        return base, set(base), 1
    found, n = set(base), 1
    for n, layer in enumerate(layers(text), 1):
        if n > 1:
            found |= {(k, *layer.source(a, b)) for k, a, b in base_spans(layer.text)}
    return base, found, n


SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_layers long"


def scan_secrets(docs: DataFrame) -> DataFrame:
    """One row for each row of docs (doc_id, text). No shuffle."""

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for text in batch.column(1).to_pylist():
            base, found, n = scan(text)
            kinds = [s[0] for s in base]
            rows.append((*(kinds.count(k) for k in KINDS), hashlib.sha256(listed(base).encode()).hexdigest(), listed(found), n))
        cols = list(zip(*rows, strict=True))
        types = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()]
        names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_layers"]
        return pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names)

    return arrow_map(docs.select("doc_id", "text"), SCHEMA, one)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(documents(spark, sf_dir))
