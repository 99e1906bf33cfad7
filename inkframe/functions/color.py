"""Colours as b, g, r columns of 0 to 255."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: All CSS colour names as RRGGBB.
NAMES = {
    "aliceblue": "F0F8FF", "antiquewhite": "FAEBD7", "aqua": "00FFFF", "aquamarine": "7FFFD4", "azure": "F0FFFF", "beige": "F5F5DC",
    "bisque": "FFE4C4", "black": "000000", "blanchedalmond": "FFEBCD", "blue": "0000FF", "blueviolet": "8A2BE2", "brown": "A52A2A",
    "burlywood": "DEB887", "cadetblue": "5F9EA0", "chartreuse": "7FFF00", "chocolate": "D2691E", "coral": "FF7F50", "cornflowerblue": "6495ED",
    "cornsilk": "FFF8DC", "crimson": "DC143C", "cyan": "00FFFF", "darkblue": "00008B", "darkcyan": "008B8B", "darkgoldenrod": "B8860B",
    "darkgray": "A9A9A9", "darkgreen": "006400", "darkgrey": "A9A9A9", "darkkhaki": "BDB76B", "darkmagenta": "8B008B", "darkolivegreen": "556B2F",
    "darkorange": "FF8C00", "darkorchid": "9932CC", "darkred": "8B0000", "darksalmon": "E9967A", "darkseagreen": "8FBC8F", "darkslateblue": "483D8B",
    "darkslategray": "2F4F4F", "darkslategrey": "2F4F4F", "darkturquoise": "00CED1", "darkviolet": "9400D3", "deeppink": "FF1493", "deepskyblue": "00BFFF",
    "dimgray": "696969", "dimgrey": "696969", "dodgerblue": "1E90FF", "firebrick": "B22222", "floralwhite": "FFFAF0", "forestgreen": "228B22",
    "fuchsia": "FF00FF", "gainsboro": "DCDCDC", "ghostwhite": "F8F8FF", "gold": "FFD700", "goldenrod": "DAA520", "gray": "808080",
    "green": "008000", "greenyellow": "ADFF2F", "grey": "808080", "honeydew": "F0FFF0", "hotpink": "FF69B4", "indianred": "CD5C5C",
    "indigo": "4B0082", "ivory": "FFFFF0", "khaki": "F0E68C", "lavender": "E6E6FA", "lavenderblush": "FFF0F5", "lawngreen": "7CFC00",
    "lemonchiffon": "FFFACD", "lightblue": "ADD8E6", "lightcoral": "F08080", "lightcyan": "E0FFFF", "lightgoldenrodyellow": "FAFAD2", "lightgray": "D3D3D3",
    "lightgreen": "90EE90", "lightgrey": "D3D3D3", "lightpink": "FFB6C1", "lightsalmon": "FFA07A", "lightseagreen": "20B2AA", "lightskyblue": "87CEFA",
    "lightslategray": "778899", "lightslategrey": "778899", "lightsteelblue": "B0C4DE", "lightyellow": "FFFFE0", "lime": "00FF00", "limegreen": "32CD32",
    "linen": "FAF0E6", "magenta": "FF00FF", "maroon": "800000", "mediumaquamarine": "66CDAA", "mediumblue": "0000CD", "mediumorchid": "BA55D3",
    "mediumpurple": "9370DB", "mediumseagreen": "3CB371", "mediumslateblue": "7B68EE", "mediumspringgreen": "00FA9A", "mediumturquoise": "48D1CC", "mediumvioletred": "C71585",
    "midnightblue": "191970", "mintcream": "F5FFFA", "mistyrose": "FFE4E1", "moccasin": "FFE4B5", "navajowhite": "FFDEAD", "navy": "000080",
    "oldlace": "FDF5E6", "olive": "808000", "olivedrab": "6B8E23", "orange": "FFA500", "orangered": "FF4500", "orchid": "DA70D6",
    "palegoldenrod": "EEE8AA", "palegreen": "98FB98", "paleturquoise": "AFEEEE", "palevioletred": "DB7093", "papayawhip": "FFEFD5", "peachpuff": "FFDAB9",
    "peru": "CD853F", "pink": "FFC0CB", "plum": "DDA0DD", "powderblue": "B0E0E6", "purple": "800080", "rebeccapurple": "663399",
    "red": "FF0000", "rosybrown": "BC8F8F", "royalblue": "4169E1", "saddlebrown": "8B4513", "salmon": "FA8072", "sandybrown": "F4A460",
    "seagreen": "2E8B57", "seashell": "FFF5EE", "sienna": "A0522D", "silver": "C0C0C0", "skyblue": "87CEEB", "slateblue": "6A5ACD",
    "slategray": "708090", "slategrey": "708090", "snow": "FFFAFA", "springgreen": "00FF7F", "steelblue": "4682B4", "tan": "D2B48C",
    "teal": "008080", "thistle": "D8BFD8", "tomato": "FF6347", "turquoise": "40E0D0", "violet": "EE82EE", "wheat": "F5DEB3",
    "white": "FFFFFF", "whitesmoke": "F5F5F5", "yellow": "FFFF00", "yellowgreen": "9ACD32",
}

BGR = tuple[int, int, int]


def to_hex(b: Column, g: Column, r: Column) -> Column:
    """#RRGGBB in capitals."""
    return F.concat(F.lit("#"), *(F.lpad(F.hex(c.cast("int")), 2, "0") for c in (r, g, b)))


def from_hex(text: Column) -> Column:
    """struct<b,g,r> of RRGGBB with or without a leading #."""
    h = F.regexp_replace(text, "^#+", "")
    part = lambda k: F.conv(F.substring(h, k, 2), 16, 10).cast("int")
    return F.struct(part(5).alias("b"), part(3).alias("g"), part(1).alias("r"))


def is_strict_hex(text: Column) -> Column:
    return text.rlike("^#[0-9A-Fa-f]{6}$")


def strict_hex(text: Column) -> Column:
    """from_hex, raising on anything but # and six digits."""
    return F.when(is_strict_hex(text), from_hex(text)).otherwise(F.raise_error(F.concat(F.lit("not a colour: "), text)).cast("struct<b:int,g:int,r:int>"))


def named(text: Column) -> Column:
    """struct<b,g,r> of an HTML name in any case, or null."""
    table = F.create_map(*(F.lit(x) for pair in NAMES.items() for x in pair))
    found = F.try_element_at(table, F.lower(text))
    return F.when(found.isNotNull(), from_hex(found))


def parse(text: str) -> BGR:
    """A colour given by a user, as #RRGGBB or a name."""
    h = NAMES.get(text.lower(), text.lstrip("#"))
    if len(h) != 6:
        raise ValueError(f"not a colour: {text}")
    return int(h[4:], 16), int(h[2:4], 16), int(h[:2], 16)


def distance(b: Column, g: Column, r: Column, to: BGR) -> Column:
    return F.sqrt(sum(((c - t) * (c - t) for c, t in zip((b, g, r), to)), F.lit(0.0)))


def in_range(channels: Sequence[Column], low: Sequence[int], high: Sequence[int]) -> Column:
    out = F.lit(True)
    for c, lo, hi in zip(channels, low, high):
        out = out & c.between(lo, hi)
    return out


def near(b: Column, g: Column, r: Column, target: BGR, tolerance: int, compat: str = "wrap") -> Column:
    """Whether each channel lies within ``tolerance`` of ``target``.

    ``wrap`` computes the bounds in unsigned bytes, so those past 0 or 255 come out at the other end and
    nothing matches; ``clamp`` stops them there.
    """
    if compat == "wrap":
        low, high = ([(t + d * tolerance) % 256 for t in target] for d in (-1, 1))
    elif compat == "clamp":
        low, high = [max(0, t - tolerance) for t in target], [min(255, t + tolerance) for t in target]
    else:
        raise ValueError(f"compat is wrap or clamp, not {compat}")
    return in_range((b, g, r), low, high)


def blackened(hit: Column, *channels: str) -> list[Column]:
    return [F.when(hit, F.lit(0)).otherwise(F.col(c)).cast("long").alias(c) for c in channels or ("b", "g", "r")]


def is_mid_gray(b: Column, g: Column, r: Column) -> Column:
    """All channels within 124 to 132."""
    return in_range((b, g, r), (124,) * 3, (132,) * 3)


def luma(b: Column, g: Column, r: Column, swap_rb: bool = False) -> Column:
    """Gray value of a pixel in 15-bit fixed point, rounded; ``swap_rb`` weighs blue as red and red as blue."""
    if swap_rb:
        b, r = r, b
    return F.floor((b * 3735 + g * 19235 + r * 9798 + 16384) / 32768).cast("long")
