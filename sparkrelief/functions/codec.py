"""Codecs of samples as Column expressions: RGB heights, 16-bit heights, child masks, zigzag, octahedral normals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accepted names of the RGB formats.
FORMAT_NAMES = {"terrarium": "terrarium", "mapbox": "mapbox", "mapbox-rgb": "mapbox", "terrain-rgb": "mapbox", "gsi": "gsi", "gsi-dem": "gsi"}
#: Media types of image containers.
CONTAINER_MIME = {"png": "image/png", "webp": "image/webp", "avif": "image/avif"}
#: Bits of the children of a tile.
CHILD_BITS = {"sw": 1, "se": 2, "nw": 4, "ne": 8}
_TOP = 16777215


def f32(x) -> Column:
    """A literal in single precision; Spark widens a float times a plain literal to double."""
    return F.lit(float(x)).cast("float")


def rgb(r: Column, g: Column, b: Column) -> Column:
    return F.struct(r.cast("int").alias("r"), g.cast("int").alias("g"), b.cast("int").alias("b"))


def _bytes(v: Column) -> Column:
    """The three bytes of a 24-bit number."""
    return rgb(F.shiftright(v, 16).bitwiseAND(255), F.shiftright(v, 8).bitwiseAND(255), v.bitwiseAND(255))


def _number(v: Column, top: float = _TOP) -> Column:
    """A float limited to 0 .. top as an integer; NaN gives 0."""
    return F.when(F.isnan(v), F.lit(0).cast("long")).otherwise(F.greatest(f32(0), F.least(v, f32(top))).cast("long"))


def encode_terrarium(e: Column) -> Column:
    return _bytes(_number((e.cast("float") + f32(32768)) * f32(256)))


def decode_terrarium(p: Column) -> Column:
    return p.r.cast("float") * f32(256) + p.g.cast("float") + p.b.cast("float") / f32(256) - f32(32768)


def encode_mapbox(e: Column) -> Column:
    v = (e.cast("float") + f32(10000)) * f32(10)
    near = F.when(F.isnan(v), v).otherwise(F.round(F.greatest(f32(-10), F.least(v, f32(2e7)))).cast("float"))
    return _bytes(_number(near))


def decode_mapbox(p: Column) -> Column:
    return f32(-10000) + (p.r.cast("float") * f32(65536) + p.g.cast("float") * f32(256) + p.b.cast("float")) * f32(0.1)


def encode_gsi(e: Column) -> Column:
    """Hundredths of a metre modulo 2**24; NaN has a value of its own. Beyond 64 bits they stop at the largest and smallest number, also for infinity."""
    v = e.cast("float").cast("double") * 100
    top = F.lit(float(1 << 63))
    near = F.round(F.when(F.isnan(v) | (F.abs(v) >= top), 0.0).otherwise(v)).cast("long")
    whole = F.when(v >= top, F.lit((1 << 63) - 1)).when(v <= -top, F.lit(-(1 << 63))).otherwise(near)
    return F.when(F.isnan(e), rgb(F.lit(128), F.lit(0), F.lit(0))).otherwise(_bytes(F.pmod(whole, F.lit(1 << 24))))


def decode_gsi(p: Column) -> Column:
    v = p.r.cast("long") * 65536 + p.g * 256 + p.b
    m = F.when(v < 8388608, v * F.lit(0.01)).when(v > 8388608, (v - (1 << 24)) * F.lit(0.01)).otherwise(F.lit(float("nan")))
    return m.cast("float")


def format_name(name: Column) -> Column:
    """The canonical name of an RGB format; an unknown one raises an error."""
    low, out = F.lower(name), None
    for alias, canonical in FORMAT_NAMES.items():
        out = F.when(low == alias, canonical) if out is None else out.when(low == alias, canonical)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown height format: "), name)))


def encode_height(name: Column, e: Column) -> Column:
    return F.when(name == "terrarium", encode_terrarium(e)).when(name == "mapbox", encode_mapbox(e)).when(name == "gsi", encode_gsi(e))


def decode_height(name: Column, p: Column) -> Column:
    return F.when(name == "terrarium", decode_terrarium(p)).when(name == "mapbox", decode_mapbox(p)).when(name == "gsi", decode_gsi(p))


def encode_heights(name: Column, heights: Column) -> Column:
    """Bulk form: an array of heights to an array of pixels."""
    return F.transform(heights, lambda e: encode_height(name, e))


def decode_heights(name: Column, pixels: Column) -> Column:
    return F.transform(pixels, lambda p: decode_height(name, p))


def pack_rgb(pixels: Column) -> Column:
    """An array of pixels as bytes, three each."""
    return F.unhex(F.array_join(F.transform(pixels, lambda p: F.concat(*[F.lpad(F.hex(p[c]), 2, "0") for c in "rgb"])), ""))


def packed_pixel(content: Column, i: Column) -> Column:
    """The pixel number ``i`` of packed bytes."""
    byte = lambda k: F.conv(F.hex(F.substr(content, (i * 3 + k + 1).cast("int"), F.lit(1))), 16, 10)
    return rgb(byte(0), byte(1), byte(2))


def checked_rgb(content: Column, width: Column, height: Column) -> Column:
    """Packed bytes; an error if they are not three for each pixel."""
    fits = F.octet_length(content) == width * height * 3
    return F.when(fits, content).otherwise(F.raise_error(F.concat(F.octet_length(content).cast("string"), F.lit(" packed bytes are not three for each pixel"))).cast("binary"))


def height_at(name: Column, content: Column, width: Column, x: Column, y: Column) -> Column:
    """The height at one pixel of packed bytes; the others are not decoded."""
    return decode_height(name, packed_pixel(content, y * width + x))


def unpack_rgb(content: Column) -> Column:
    """Packed bytes as an array of pixels."""
    n = F.floor(F.octet_length(content) / 3).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), lambda i: packed_pixel(content, i))).otherwise(F.array().cast("array<struct<r:int,g:int,b:int>>"))


def container_name(name: Column) -> Column:
    """png, webp or avif from a name or media type, in any case; an unknown one raises an error."""
    low = F.regexp_replace(F.lower(name), "^image/", "")
    return F.when(low.isin(*CONTAINER_MIME), low).otherwise(F.raise_error(F.concat(F.lit("unknown container: "), name)))


def elevation_to_u16(e: Column) -> Column:
    return F.when(F.isnan(e), 0).otherwise(F.round((F.greatest(F.lit(-1000.0), F.least(e.cast("double"), F.lit(12107.0))) + 1000) * 5).cast("int"))


def u16_to_elevation(v: Column) -> Column:
    return v / 5 - 1000


def u16_bytes(values: Column, least: int = 0) -> Column:
    """Values as 16-bit little-endian bytes; an error if there are fewer than ``least``."""
    pair = lambda v: F.concat(F.lpad(F.hex(v.cast("long") % 256), 2, "0"), F.lpad(F.hex(F.floor(v / 256)), 2, "0"))
    made = F.unhex(F.array_join(F.transform(values, pair), ""))
    return F.when(F.size(values) < least, F.raise_error(F.lit(f"at least {least} values are needed"))).otherwise(made) if least else made


def u16_values(content: Column) -> Column:
    """The values of 16-bit little-endian bytes; an odd last byte is ignored."""
    n = F.floor(F.octet_length(content) / 2).cast("int")
    digits = F.hex(content)
    value = lambda i: F.conv(F.concat(F.substr(digits, i * 4 + 3, F.lit(2)), F.substr(digits, i * 4 + 1, F.lit(2))), 16, 10).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), value)).otherwise(F.array().cast("array<int>"))


def child_mask(sw: Column, se: Column, nw: Column, ne: Column) -> Column:
    out = F.lit(0)
    for c, bit in zip((sw, se, nw, ne), CHILD_BITS.values(), strict=True):
        out = out.bitwiseOR(F.when(c, bit).otherwise(0))
    return out


def child_flags(mask: Column) -> Column:
    return F.struct(*[(mask.bitwiseAND(bit) != 0).alias(name) for name, bit in CHILD_BITS.items()])


def zigzag(v: Column) -> Column:
    """A signed 32-bit number with its sign in the lowest bit."""
    return F.shiftleft(v.cast("long"), 1).bitwiseXOR(F.shiftright(v.cast("long"), 63)).bitwiseAND(F.lit(0xFFFFFFFF).cast("long"))


def unzigzag(v: Column) -> Column:
    return F.shiftright(v.cast("long"), 1).bitwiseXOR(-v.cast("long").bitwiseAND(F.lit(1).cast("long")))


def oct_encode(n: Column) -> Column:
    """Two bytes of a unit vector: the octahedron, with its lower half folded out, in single precision."""
    x, y, z = (n[c].cast("float") for c in "xyz")
    total = F.abs(x) + F.abs(y) + F.abs(z)
    safe = F.when(total == 0, f32(1)).otherwise(total)
    px, py = x / safe, y / safe
    px, py = px.cast("float"), py.cast("float")
    sign = lambda v: F.when(v >= 0, f32(1)).otherwise(f32(-1))
    fx, fy = (f32(1) - F.abs(py)) * sign(px), (f32(1) - F.abs(px)) * sign(py)
    byte = lambda v: F.greatest(f32(0), F.least(((v * f32(0.5) + f32(0.5)) * f32(255)), f32(255))).cast("int")
    return F.struct(byte(F.when(z < 0, fx).otherwise(px)).alias("a"), byte(F.when(z < 0, fy).otherwise(py)).alias("b"))


def oct_pairs(content: Column) -> Column:
    """Bytes of normals as an array of structs a, b; an odd last byte is ignored."""
    n = F.floor(F.octet_length(content) / 2).cast("int")
    byte = lambda i: F.conv(F.hex(F.substr(content, i + 1, F.lit(1))), 16, 10).cast("int")
    pair = lambda i: F.struct(byte(i * 2).alias("a"), byte(i * 2 + 1).alias("b"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), pair)).otherwise(F.array().cast("array<struct<a:int,b:int>>"))


def oct_decode(o: Column) -> Column:
    """The unit vector of two bytes; (0, 0, 1) if it has no length."""
    x, y = (o[c].cast("double") / 255 * 2 - 1 for c in "ab")
    z = 1 - F.abs(x) - F.abs(y)
    sign = lambda v: F.when(v >= 0, 1.0).otherwise(-1.0)
    fx, fy = F.when(z < 0, (1 - F.abs(y)) * sign(x)).otherwise(x), F.when(z < 0, (1 - F.abs(x)) * sign(y)).otherwise(y)
    m = F.sqrt(fx * fx + fy * fy + z * z)
    part = lambda v, zero: F.when(m > 0, v / m).otherwise(zero).cast("float")
    return F.struct(part(fx, 0.0).alias("x"), part(fy, 0.0).alias("y"), part(z, 1.0).alias("z"))
