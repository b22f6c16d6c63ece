"""Point, colour and tone formulas. Each takes a dialect and returns the SQL of its channels."""

from __future__ import annotations

from .numeric import Dialect, weighted

RGB = ["r", "g", "b"]

# Luma weights, YUV matrices and tone curves of the standards that the formulas follow.
BT601, BT709 = [0.299, 0.587, 0.114], [0.2126, 0.7152, 0.0722]
YUV = [[0.299, 0.587, 0.114], [-0.169, -0.331, 0.5], [0.5, -0.419, -0.081]]
SEPIA = [[0.393, 0.769, 0.189], [0.349, 0.686, 0.168], [0.272, 0.534, 0.131]]
#: v of red, u and v of green, u of blue, by variant.
YUV_INVERSE = {"plain": (1.4, 0.343, 0.711, 1.765), "shader": (1.402, 0.344, 0.714, 1.772), "jfif": (1.402, 0.344136, 0.714136, 1.772)}
ACES = (2.51, 0.03, 2.43, 0.59, 0.14)
FILMIC = (0.15, 0.50, 0.10, 0.20, 0.02, 0.30)
FILMIC_WHITE, FILMIC_BIAS = 11.2, 2.0

# White points (X, Y, Z), working spaces and profiles: name, gamma, primaries, RGB to XYZ, XYZ to RGB.
WHITE_POINTS = {"d65": (95.047, 100.0, 108.883), "d50": (96.422, 100.0, 82.521), "a": (109.850, 100.0, 35.585), "c": (98.074, 100.0, 118.232)}
_SRGB = ((0.4124564, 0.3575761, 0.1804375, 0.2126729, 0.7151522, 0.0721750, 0.0193339, 0.1191920, 0.9503041), (3.2404542, -1.5371385, -0.4985314, -0.9692660, 1.8760108, 0.0415560, 0.0556434, -0.2040259, 1.0572252))
_ADOBE = ((0.5767309, 0.1855540, 0.1881852, 0.2973769, 0.6273491, 0.0752741, 0.0270343, 0.0706872, 0.9911085), (2.0413690, -0.5649464, -0.3446944, -0.9692660, 1.8760108, 0.0415560, 0.0134474, -0.1183897, 1.0154096))
_PROPHOTO = ((0.7976749, 0.1351917, 0.0313534, 0.2880402, 0.7118741, 0.0000857, 0.0, 0.0, 0.8252100), (1.3459433, -0.2556075, -0.0511118, -0.5445989, 1.5081673, 0.0205351, 0.0, 0.0, 1.2118128))
_REC2020 = ((0.6369580, 0.1446169, 0.1688809, 0.2627045, 0.6780980, 0.0593017, 0.0, 0.0280727, 1.0609851), (1.7166511, -0.3556708, -0.2533663, -0.6666844, 1.6164812, 0.0157685, 0.0176399, -0.0427706, 0.9421031))
_P3 = ((0.4865709, 0.2656677, 0.1982173, 0.2289746, 0.6917385, 0.0792869, 0.0, 0.0451134, 1.0439444), (2.4934969, -0.9313836, -0.4027108, -0.8294890, 1.7626641, 0.0236247, 0.0358458, -0.0761723, 0.9568845))
_SRGB_PRIMARIES = (0.64, 0.33, 0.30, 0.60, 0.15, 0.06)
PROFILES = {
    "srgb": ("sRGB IEC61966-2.1", 2.4, _SRGB_PRIMARIES, *_SRGB),
    "adobe_rgb_1998": ("Adobe RGB (1998)", 2.2, (0.64, 0.33, 0.21, 0.71, 0.15, 0.06), *_ADOBE),
    "pro_photo_rgb": ("ProPhoto RGB", 1.8, (0.7347, 0.2653, 0.1596, 0.8404, 0.0366, 0.0001), *_PROPHOTO),
    "rec2020": ("ITU-R BT.2020", 2.4, (0.708, 0.292, 0.170, 0.797, 0.131, 0.046), *_REC2020),
    "display_p3": ("Display P3", 2.4, (0.68, 0.32, 0.265, 0.69, 0.15, 0.06), *_P3),
    "rec709": ("ITU-R BT.709", 2.4, _SRGB_PRIMARIES, *_SRGB),
    "linear_rgb": ("Linear RGB", 1.0, _SRGB_PRIMARIES, *_SRGB),
}
PROFILE_WHITE = (0.3127, 0.3290)
WORKING_SPACES = {"srgb": "srgb", "adobe_rgb": "adobe_rgb_1998", "pro_photo_rgb": "pro_photo_rgb", "rec2020": "rec2020"}


# --- point -----------------------------------------------------------------------------------------------------------
def brightness(d: Dialect, v: str, amount: int) -> str:
    return f"least(255, greatest(0, {v} + ({int(amount)})))"


def contrast(d: Dialect, v: str, factor: float) -> str:
    return d.byte(f"({d.f(v)} - {d.f(128)}) * {d.f(factor)} + {d.f(128)}")


def view_contrast(d: Dialect, v: str, factor: float) -> str:
    """The in-place variant, which pivots at one half of the unit range."""
    unit = f"(({d.div(d.f(v), d.f(255))} - {d.f(0.5)}) * {d.f(factor)} + {d.f(0.5)})"
    return d.byte(f"{d.clamp(unit, 0, 1)} * {d.f(255)}")


def white_balance(d: Dialect, temperature: float, tint: float) -> list[str]:
    t, n = d.div(d.f(temperature), d.f(100)), d.div(d.f(tint), d.f(100))
    one = d.f(1)
    return [
        d.byte(f"{d.f('r')} * ({one} + {t} * {d.f(0.5)}) * ({one} + {n} * {d.f(0.3)})"),
        d.byte(f"{d.f('g')} * ({one} - abs({t}) * {d.f(0.1)}) * ({one} - {n} * {d.f(0.3)})"),
        d.byte(f"{d.f('b')} * ({one} - {t} * {d.f(0.5)})"),
    ]


def gamma(d: Dialect, v: str, g: float) -> str:
    return d.trunc(f"{d.pow(d.div(d.f(v), d.f(255)), f'1.0 / CAST({g} AS FLOAT)')} * {d.f(255)}")


def grey(d: Dialect, weights: list[float]) -> str:
    return d.trunc(weighted(d, weights, RGB))


def blend(d: Dialect, source: str, target: str, alpha: float) -> str:
    return d.byte(f"{d.f(source)} * {d.f(alpha)} + {d.f(target)} * ({d.f(1)} - {d.f(alpha)})")


def sepia(d: Dialect) -> list[str]:
    return [d.byte(weighted(d, w, RGB)) for w in SEPIA]


# --- colour spaces ---------------------------------------------------------------------------------------------------
def rgb_to_yuv(d: Dialect) -> list[str]:
    return [d.byte(weighted(d, w, RGB, None if k == 0 else 128)) for k, w in enumerate(YUV)]


def yuv_to_rgb(d: Dialect, variant: str = "plain", names: tuple[str, str, str] = ("r", "g", "b")) -> list[str]:
    rv, gu, gv, bu = YUV_INVERSE[variant]
    y, u, v = d.f(names[0]), f"({d.f(names[1])} - {d.f(128)})", f"({d.f(names[2])} - {d.f(128)})"
    return [d.byte(f"{y} + {d.f(rv)} * {v}"), d.byte(f"{y} - {d.f(gu)} * {u} - {d.f(gv)} * {v}"), d.byte(f"{y} + {d.f(bu)} * {u}")]


def rgb_to_hsv(d: Dialect) -> list[str]:
    r, g, b = (d.div(d.f(c), d.f(255)) for c in RGB)
    top, low = f"greatest({r}, {g}, {b})", f"least({r}, {g}, {b})"
    delta = f"({top} - {low})"
    six = f"CASE WHEN {g} < {b} THEN {d.f(6)} ELSE {d.f(0)} END"
    hue = (
        f"CASE WHEN {delta} = {d.f(0)} THEN {d.f(0)} WHEN {top} = {r} THEN {d.f(60)} * ({d.div(f'{g} - {b}', delta)} + {six}) "
        f"WHEN {top} = {g} THEN {d.f(60)} * ({d.div(f'{b} - {r}', delta)} + {d.f(2)}) ELSE {d.f(60)} * ({d.div(f'{r} - {g}', delta)} + {d.f(4)}) END"
    )
    sat = f"CASE WHEN {top} = {d.f(0)} THEN {d.f(0)} ELSE {d.div(delta, top)} END"
    return [d.trunc(d.div(f"({hue}) * {d.f(255)}", d.f(360))), d.trunc(f"({sat}) * {d.f(255)}"), d.trunc(f"{top} * {d.f(255)}")]


def hsv_to_rgb(d: Dialect) -> list[str]:
    """Of samples in columns r, g, b that hold hue, saturation and value."""
    h, s, v = d.div(f"{d.f('r')} * {d.f(360)}", d.f(255)), d.div(d.f("g"), d.f(255)), d.div(d.f("b"), d.f(255))
    c = f"({v} * {s})"
    x = f"({c} * ({d.f(1)} - abs({d.mod2(d.div(h, d.f(60)))} - {d.f(1)})))"
    m, zero = f"({v} - {c})", d.f(0)
    sectors = [(c, x, zero), (x, c, zero), (zero, c, x), (zero, x, c), (x, zero, c), (c, zero, x)]
    out = []
    for k in range(3):
        cases = " ".join(f"WHEN {h} < {d.f(60 * (i + 1))} THEN {sectors[i][k]}" for i in range(5))
        out.append(d.trunc(f"(CASE {cases} ELSE {sectors[5][k]} END + {m}) * {d.f(255)}"))
    return out


def to_linear(d: Dialect, v: str, profile: str) -> str:
    """Transfer of a channel from 0 to 1 to light."""
    if profile == "linear_rgb":
        return v
    if profile != "srgb":
        return d.pow(f"greatest({d.f(0)}, {v})", PROFILES[profile][1])
    c = d.clamp(v, 0, 1)
    return f"CASE WHEN {c} <= {d.f(0.04045)} THEN {d.div(c, d.f(12.92))} ELSE {d.pow(d.div(f'{c} + {d.f(0.055)}', d.f(1.055)), 2.4)} END"


def from_linear(d: Dialect, v: str, profile: str) -> str:
    if profile == "linear_rgb":
        return v
    if profile != "srgb":
        return d.pow(f"greatest({d.f(0)}, {v})", f"1.0 / CAST({PROFILES[profile][1]} AS FLOAT)")
    c = d.clamp(v, 0, 1)
    return f"CASE WHEN {c} <= {d.f(0.0031308)} THEN {c} * {d.f(12.92)} ELSE {d.f(1.055)} * {d.pow(c, '1.0 / CAST(2.4 AS FLOAT)')} - {d.f(0.055)} END"


def matrix(d: Dialect, m: tuple, channels: list[str]) -> list[str]:
    return [weighted(d, list(m[3 * k : 3 * k + 3]), channels) for k in range(3)]


def lab_f(d: Dialect, t: str) -> str:
    delta = 6.0 / 29.0
    return f"CASE WHEN {t} > {d.f(delta**3)} THEN {d.pow(t, '1.0 / CAST(3.0 AS FLOAT)')} ELSE {d.div(t, d.f(3 * delta * delta))} + {d.f(4.0 / 29.0)} END"


def lab_f_inverse(d: Dialect, t: str) -> str:
    delta = 6.0 / 29.0
    return f"CASE WHEN {t} > {d.f(delta)} THEN {t} * {t} * {t} ELSE {d.f(3 * delta * delta)} * ({t} - {d.f(4.0 / 29.0)}) END"


# --- tone ------------------------------------------------------------------------------------------------------------
def luminance(d: Dialect, exposure: float = 1.0) -> str:
    return weighted(d, BT709, [f"(c{k} * {d.f(exposure)})" if exposure != 1.0 else f"c{k}" for k in range(3)])


def display(d: Dialect, v: str, gamma_: float = 2.2) -> str:
    """Gamma and conversion to a sample."""
    return d.byte(f"(CASE WHEN {v} <= {d.f(0)} THEN {d.f(0)} ELSE {d.pow(v, f'1.0 / CAST({gamma_} AS FLOAT)')} END) * {d.f(255)}")


def filmic(d: Dialect, x: str) -> str:
    a, b, c, dd, e, f = (d.f(v) for v in FILMIC)
    return f"({d.div(f'{x} * ({a} * {x} + {c} * {b}) + {dd} * {e}', f'{x} * ({a} * {x} + {b}) + {dd} * {f}')} - {d.div(e, f)})"


def tone(d: Dialect, c: str, operator: str, lum: str = "lum", average: str = "avg_lum", key: float = 0.18, white: float = 1.0) -> str:
    """A channel c, already exposed, by a tone operator; lum is the pixel's luminance, average the image's."""
    if operator == "linear":
        return d.clamp(c, 0, 1)
    if operator == "exposure":
        return f"({d.f(1)} - {d.exp(f'-{c} * {d.f(2)}')})"
    if operator in ("reinhard", "reinhard_extended"):
        scaled = d.div(f"{d.f(key)} * {lum}", f"{average} + {d.f(0.001)}")
        up = f"{scaled} * ({d.f(1)} + {d.div(scaled, d.f(white * white))})" if operator == "reinhard_extended" else scaled
        mapped = d.div(up, f"{d.f(1)} + {scaled}")
        return f"CASE WHEN {lum} <= {d.f(0)} THEN {d.f(0)} ELSE {c} * {d.div(mapped, lum)} END"
    if operator == "aces":
        a, b, cc, dd, e = (d.f(v) for v in ACES)
        return d.clamp(d.div(f"{c} * ({a} * {c} + {b})", f"{c} * ({cc} * {c} + {dd}) + {e}"), 0, 1)
    if operator == "uncharted2":
        return f"({filmic(d, f'({c} * {d.f(FILMIC_BIAS)})')} * {d.div(d.f(1), filmic(d, d.f(FILMIC_WHITE)))})"
    raise ValueError(f"UnsupportedToneOperator: {operator}")


TONE_OPERATORS = ("linear", "exposure", "reinhard", "reinhard_extended", "aces", "uncharted2")
