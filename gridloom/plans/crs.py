"""Coordinate reference systems and their projections.

A projection is a list of steps, each naming the values of expressions over earlier
names.  The expressions use only what Spark SQL, DuckDB and Python share, so that
one text serves as columns, as SQL for checks, and for bounds worked out on the driver.
"""

from __future__ import annotations

import math
import re
from collections.abc import Mapping
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Steps = tuple[tuple[str, str], ...]

_FUNCTIONS = {
    n: getattr(math, n) for n in ("sin", "cos", "tan", "asin", "atan", "atan2", "sinh", "cosh", "atanh", "sqrt", "exp", "radians", "degrees", "ceil")
} | {"ln": math.log, "pow": pow, "greatest": max, "least": min, "abs": abs}


@dataclass(frozen=True)
class CRS:
    """A coordinate reference system: its name, family, and the family's parameters."""

    name: str
    family: str = "geographic"
    parameters: tuple[tuple[str, float], ...] = ()
    grid_mapping_name: str = "latitude_longitude"

    @property
    def is_geographic(self) -> bool:
        return self.family in ("geographic", "rotated")

    @property
    def unit_name(self) -> str:
        return "degree" if self.is_geographic else "metre"

    def equals(self, other: CRS) -> bool:
        return (self.family, self.parameters) == (other.family, other.parameters)

    def agrees(self, other: CRS) -> bool:
        """Whether coordinates of both mean the same places: equal systems, or longitudes and latitudes of one datum."""
        return self.equals(other) or self.family == other.family == "geographic" and self.shifts == other.shifts

    @property
    def shifts(self) -> tuple[float, ...]:
        """Semi-major axis, inverse flattening and seven parameters to WGS 84; empty for datums that are taken for it."""
        p = dict(self.parameters)
        return (p["a"], p["rf"], *(p[k] for k in _SHIFTS)) if _SHIFTS[0] in p else ()

    def to_cf(self) -> dict[str, object]:
        """Attributes that describe the system in the CF manner."""
        return {"grid_mapping_name": self.grid_mapping_name, "crs_name": self.name, **dict(self.parameters)}

    @staticmethod
    def from_any(crs: CRS | str | Mapping[str, object]) -> CRS:
        """A system given as itself, by an identifier, or by CF attributes."""
        if isinstance(crs, CRS):
            return crs
        if isinstance(crs, str):
            return _named(crs)
        if isinstance(crs, Mapping):
            return _from_cf(crs)
        raise ValueError(f"unsupported CRS: {crs!r}")

    def forward(self) -> Steps:
        """Steps from lon, lat in degrees to x, y."""
        return _steps(self, False)

    def inverse(self) -> Steps:
        """Steps from x, y to lon, lat in degrees."""
        return _steps(self, True)


#: Semi-major axis and inverse flattening of the ellipsoids WGS 84 and GRS 1980.
WGS84, GRS80 = (6378137.0, 298.257223563), (6378137.0, 298.257222101)


def _crs(name: str, family: str, cf: str, ellipsoid: tuple[float, float], **parameters: float) -> CRS:
    return CRS(name, family, tuple(sorted({"a": ellipsoid[0], "rf": ellipsoid[1], **parameters}.items())), cf)


#: Names of the seven parameters (metres, arc seconds, parts in a million; position vector), and of datums their
#: ellipsoid and parameters to WGS 84.
_SHIFTS = ("tx", "ty", "tz", "rx", "ry", "rz", "ds")
DATUMS = {
    "WGS84": (WGS84, ()), "ETRS89": (GRS80, ()), "NAD83": (GRS80, ()), "GDA94": (GRS80, ()),
    "OSGB36": ((6377563.396, 299.3249646), (446.448, -125.157, 542.06, 0.15, 0.247, 0.842, -20.489)),
    "DHDN": ((6377397.155, 299.1528128), (598.1, 73.7, 418.2, 0.202, 0.045, -2.455, 6.7)),
    "ED50": ((6378388.0, 297.0), (-87.0, -98.0, -121.0, 0.0, 0.0, 0.0, 0.0)),
}
#: The names that CF attributes and registries have for these datums, in small letters without signs.
_DATUM_NAMES = {
    "wgs84": "WGS84", "wgs1984": "WGS84", "worldgeodeticsystem1984": "WGS84", "etrs89": "ETRS89", "europeanterrestrialreferencesystem1989": "ETRS89", "nad83": "NAD83", "northamericandatum1983": "NAD83",
    "gda94": "GDA94", "geocentricdatumofaustralia1994": "GDA94", "osgb36": "OSGB36", "osgb1936": "OSGB36", "ordnancesurveyofgreatbritain1936": "OSGB36",
    "dhdn": "DHDN", "deutscheshauptdreiecksnetz": "DHDN", "ed50": "ED50", "europeandatum1950": "ED50",
}


def _datum(name: str) -> tuple[tuple[float, float], dict[str, float]]:
    """A datum's ellipsoid, and its parameters to WGS 84 if it isn't taken for that."""
    ellipsoid, shift = DATUMS[name]
    return ellipsoid, dict(zip(_SHIFTS, shift, strict=True)) if shift else {}


CRS_WGS84 = CRS("EPSG:4326")
CRS_CRS84 = CRS("OGC:CRS84")


def _utm(zone: int, south: bool, ellipsoid: tuple[float, float], name: str) -> CRS:
    return _crs(name, "tmerc", "transverse_mercator", ellipsoid, lon0=6.0 * zone - 183, lat0=0.0, k0=0.9996, fe=500000.0, fn=10000000.0 if south else 0.0)


@lru_cache(maxsize=256)
def _named(text: str) -> CRS:
    key = text.strip().upper()
    code = re.fullmatch(r"(?:EPSG:|URN:OGC:DEF:CRS:EPSG:[0-9.]*:)?(\d+)", key)
    if key in ("OGC:CRS84", "CRS84", "URN:OGC:DEF:CRS:OGC:1.3:CRS84"):
        return CRS_CRS84
    if code:
        n, name = int(code[1]), f"EPSG:{int(code[1])}"
        if n in (4326, 4258, 4269, 4979):
            return CRS(name)
        if 32601 <= n <= 32660 or 32701 <= n <= 32760:
            return _utm(n % 100, n >= 32700, WGS84, name)
        if 25828 <= n <= 25838:
            return _utm(n % 100, False, GRS80, name)
        if n == 3035:
            return _crs(name, "laea", "lambert_azimuthal_equal_area", GRS80, lon0=10.0, lat0=52.0, fe=4321000.0, fn=3210000.0)
        if n in (6931, 6932):
            return _crs(name, "laea", "lambert_azimuthal_equal_area", WGS84, lon0=0.0, lat0=90.0 if n == 6931 else -90.0, fe=0.0, fn=0.0)
        if n in (3571, 3572, 3573, 3574, 3575, 3576):
            return _crs(name, "laea", "lambert_azimuthal_equal_area", WGS84, lon0=(180.0, -150.0, -100.0, -40.0, 10.0, 90.0)[n - 3571], lat0=90.0, fe=0.0, fn=0.0)
        if n == 3857:
            return _crs(name, "webmerc", "mercator", WGS84, lon0=0.0, fe=0.0, fn=0.0)
        if n == 3034:
            return _crs(name, "lcc", "lambert_conformal_conic", GRS80, lon0=10.0, lat0=52.0, lat1=35.0, lat2=65.0, fe=4000000.0, fn=2800000.0)
        if n == 2154:
            return _crs(name, "lcc", "lambert_conformal_conic", GRS80, lon0=3.0, lat0=46.5, lat1=49.0, lat2=44.0, fe=700000.0, fn=6600000.0)
        if n == 5243:
            return _crs(name, "lcc", "lambert_conformal_conic", GRS80, lon0=10.5, lat0=51.0, lat1=48.0 + 2 / 3, lat2=53.0 + 2 / 3, fe=0.0, fn=0.0)
        if n in (4277, 4314, 4230):
            return _geographic(name, {4277: "OSGB36", 4314: "DHDN", 4230: "ED50"}[n])
        if n == 27700:
            ellipsoid, shift = _datum("OSGB36")
            return _crs(name, "tmerc", "transverse_mercator", ellipsoid, lon0=-2.0, lat0=49.0, k0=0.9996012717, fe=400000.0, fn=-100000.0, **shift)
        if 31466 <= n <= 31469:
            ellipsoid, shift = _datum("DHDN")
            zone = n - 31464
            return _crs(name, "tmerc", "transverse_mercator", ellipsoid, lon0=3.0 * zone, lat0=0.0, k0=1.0, fe=1e6 * zone + 500000.0, fn=0.0, **shift)
        if n in (3031, 3413, 3995):
            lat_ts, lon0 = {3031: (-71.0, 0.0), 3413: (70.0, -45.0), 3995: (71.0, 0.0)}[n]
            return _crs(name, "stere", "polar_stereographic", WGS84, lon0=lon0, lat0=math.copysign(90.0, lat_ts), lat1=lat_ts, k0=1.0, fe=0.0, fn=0.0)
        if n in (32661, 32761):
            return _crs(name, "stere", "polar_stereographic", WGS84, lon0=0.0, lat0=90.0 if n == 32661 else -90.0, lat1=90.0, k0=0.994, fe=2000000.0, fn=2000000.0)
        if n in (5070, 3005, 3577):
            lon0, lat0, lat1, lat2, fe = {5070: (-96.0, 23.0, 29.5, 45.5, 0.0), 3005: (-126.0, 45.0, 50.0, 58.5, 1000000.0), 3577: (132.0, 0.0, -18.0, -36.0, 0.0)}[n]
            return _crs(name, "aea", "albers_conical_equal_area", GRS80, lon0=lon0, lat0=lat0, lat1=lat1, lat2=lat2, fe=fe, fn=0.0)
        if n == 3395:
            return _crs(name, "merc", "mercator", WGS84, lon0=0.0, k0=1.0, fe=0.0, fn=0.0)
    raise ValueError(f"unsupported CRS: {text!r}")


def _geographic(name: str, datum: str) -> CRS:
    ellipsoid, shift = _datum(datum)
    return _crs(name, "geographic", "latitude_longitude", ellipsoid, **shift) if shift else CRS(name)


def _from_cf(attrs: Mapping[str, object]) -> CRS:
    kind = attrs.get("grid_mapping_name")
    number = lambda key, default=0.0: float(attrs.get(key, default))  # type: ignore[arg-type]
    shift: dict[str, float] = {}
    own = WGS84
    if told := str(attrs.get("horizontal_datum_name", "")):
        key = re.sub("[^a-z0-9]", "", told.lower())
        if key not in _DATUM_NAMES:
            raise ValueError(f"unknown datum: {told!r}")
        own, shift = _datum(_DATUM_NAMES[key])
    if "towgs84" in attrs:
        given = [float(v) for v in attrs["towgs84"]]  # type: ignore[attr-defined]
        shift = dict(zip(_SHIFTS, given + [0.0] * (7 - len(given)), strict=True))
    if "earth_radius" in attrs:
        own = (number("earth_radius"), math.inf)
    ellipsoid = (number("semi_major_axis", own[0]), number("inverse_flattening", own[1]) or math.inf)
    offsets = {"fe": number("false_easting"), "fn": number("false_northing"), **shift}
    if "crs_name" in attrs:
        if kind in ("mercator", "rotated_latitude_longitude") and ("k0" in attrs or "pole_lat" in attrs):
            return CRS(str(attrs["crs_name"]), "merc" if kind == "mercator" else "rotated", tuple(sorted((k, float(v)) for k, v in attrs.items() if k in _PARAMETERS)), str(kind))  # type: ignore[arg-type]
        return _named(str(attrs["crs_name"])) if "latitude_longitude" == kind or not attrs.get("rf") else CRS(
            str(attrs["crs_name"]), {v: k for k, v in _FAMILIES.items()}[kind], tuple(sorted((k, float(v)) for k, v in attrs.items() if k in _PARAMETERS)), str(kind)  # type: ignore[arg-type]
        )
    if kind == "latitude_longitude":
        return _crs("longitude and latitude", "geographic", kind, ellipsoid, **shift) if shift else CRS_WGS84
    if kind == "rotated_latitude_longitude":
        pole = {"pole_lat": number("grid_north_pole_latitude"), "pole_lon": number("grid_north_pole_longitude")}
        if number("north_pole_grid_longitude"):
            pole["grid_lon"] = number("north_pole_grid_longitude")
        return CRS("rotated pole", "rotated", tuple(sorted(pole.items())), str(kind))
    if kind == "transverse_mercator":
        return _crs("transverse Mercator", "tmerc", kind, ellipsoid, lon0=number("longitude_of_central_meridian"), lat0=number("latitude_of_projection_origin"), k0=number("scale_factor_at_central_meridian", 1.0), **offsets)
    if kind == "lambert_azimuthal_equal_area":
        return _crs("Lambert azimuthal equal area", "laea", kind, ellipsoid, lon0=number("longitude_of_projection_origin"), lat0=number("latitude_of_projection_origin"), **offsets)
    if kind == "lambert_conformal_conic":
        both = attrs.get("standard_parallel", (0.0, 0.0))
        lat1, lat2 = (both[0], both[-1]) if isinstance(both, (list, tuple)) else (both, both)
        return _crs("Lambert conformal conic", "lcc", kind, ellipsoid, lon0=number("longitude_of_central_meridian"), lat0=number("latitude_of_projection_origin"), lat1=float(lat1), lat2=float(lat2), **offsets)  # type: ignore[arg-type]
    meridian = number("longitude_of_projection_origin", number("longitude_of_central_meridian"))
    if kind == "polar_stereographic":
        lat0 = math.copysign(90.0, number("latitude_of_projection_origin", 90.0))
        scale = {"lat1": float(attrs["standard_parallel"]), "k0": 1.0} if "standard_parallel" in attrs else {"lat1": 90.0, "k0": number("scale_factor_at_projection_origin", 1.0)}  # type: ignore[arg-type]
        return _crs("polar stereographic", "stere", kind, ellipsoid, lon0=number("straight_vertical_longitude_from_pole", meridian), lat0=lat0, **scale, **offsets)
    if kind == "albers_conical_equal_area":
        both = attrs.get("standard_parallel", (0.0, 0.0))
        lat1, lat2 = (both[0], both[-1]) if isinstance(both, (list, tuple)) else (both, both)
        return _crs("Albers equal area", "aea", kind, ellipsoid, lon0=number("longitude_of_central_meridian"), lat0=number("latitude_of_projection_origin"), lat1=float(lat1), lat2=float(lat2), **offsets)  # type: ignore[arg-type]
    if kind == "sinusoidal":
        return _crs("sinusoidal", "sinu", kind, ellipsoid, lon0=meridian, **offsets)
    if kind == "mercator":
        lat_ts, e2 = math.radians(number("standard_parallel")), (2 - 1 / ellipsoid[1]) / ellipsoid[1]
        k0 = number("scale_factor_at_projection_origin", math.cos(lat_ts) / math.sqrt(1 - e2 * math.sin(lat_ts) ** 2))
        return _crs("Mercator", "merc", kind, ellipsoid, lon0=meridian, k0=k0, **offsets)
    if kind == "geostationary":
        sweep = 1.0 if str(attrs.get("sweep_angle_axis", "x" if attrs.get("fixed_angle_axis") == "y" else "y")) == "x" else 0.0
        return _crs("geostationary", "geos", kind, ellipsoid, lon0=meridian, height=number("perspective_point_height"), sweep_x=sweep, **offsets)
    raise ValueError(f"unsupported CRS: {dict(attrs)!r}")


_FAMILIES = {
    "tmerc": "transverse_mercator", "laea": "lambert_azimuthal_equal_area", "webmerc": "mercator", "lcc": "lambert_conformal_conic", "stere": "polar_stereographic", "aea": "albers_conical_equal_area",
    "sinu": "sinusoidal", "geos": "geostationary", "rotated": "rotated_latitude_longitude",
}
_PARAMETERS = ("a", "rf", "lon0", "lat0", "lat1", "lat2", "k0", "fe", "fn", "height", "sweep_x", "pole_lat", "pole_lon", "grid_lon", *_SHIFTS)


def _num(x: float) -> str:
    """A double literal that Spark SQL, DuckDB and Python all read as one."""
    return f"({x:.17e})" if x < 0 else f"{x:.17e}"


def _series(terms: list[float], outer: str, x: str, inner: str = "", y: str = "") -> str:
    """The sum of terms[k] * outer(2 (k + 1) x) * inner(2 (k + 1) y)."""
    return " + ".join(f"{_num(c)} * {outer}({2 * k}.0e0 * {x})" + (f" * {inner}({2 * k}.0e0 * {y})" if inner else "") for k, c in enumerate(terms, 1))


@lru_cache(maxsize=512)
def _steps(crs: CRS, back: bool) -> Steps:
    if crs.family == "geographic":
        return (("lon", "x"), ("lat", "y")) if back else (("x", "lon"), ("y", "lat"))
    p = dict(crs.parameters)
    steps = {"tmerc": _tmerc, "laea": _laea, "webmerc": _webmerc, "lcc": _lcc, "rotated": _rotated, "stere": _stere, "aea": _aea, "sinu": _sinu, "merc": _merc, "geos": _geos}[crs.family](p, back)
    return tuple((n, _wrapped(text)) if back and n == "lon" else (n, text) for n, text in steps)


def _wrapped(degrees: str) -> str:
    """An angle in degrees, over -180 and up to 180."""
    return f"({degrees}) - 360.0e0 * ceil((({degrees}) - 180.0e0) / 360.0e0)"


def _tmerc(p: dict[str, float], back: bool) -> Steps:
    """Transverse Mercator by Krueger's series in the third flattening, to its fourth power."""
    f = 1 / p["rf"]
    n = f / (2 - f)
    radius = p["k0"] * p["a"] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    c = 2 * math.sqrt(n) / (1 + n)
    origin = 0.0
    if p["lat0"]:
        s = math.sin(math.radians(p["lat0"]))
        t = math.sinh(math.atanh(s) - c * math.atanh(c * s))
        xi = math.atan(t)
        origin = radius * (xi + sum(a * math.sin(2 * k * xi) for k, a in enumerate(alpha, 1)))
    fn = p["fn"] - origin
    if not back:
        return (
            ("sl", "sin(radians(lat))"), ("dl", f"radians(lon - {_num(p['lon0'])})"),
            ("tt", f"sinh(atanh(sl) - {_num(c)} * atanh({_num(c)} * sl))"),
            ("xi", "atan2(tt, cos(dl))"), ("eta", "atanh(sin(dl) / sqrt(1.0e0 + tt * tt))"),
            ("x", f"{_num(p['fe'])} + {_num(radius)} * (eta + {_series(alpha, 'cos', 'xi', 'sinh', 'eta')})"),
            ("y", f"{_num(fn)} + {_num(radius)} * (xi + {_series(alpha, 'sin', 'xi', 'cosh', 'eta')})"),
        )
    return (
        ("xi0", f"(y - {_num(fn)}) / {_num(radius)}"), ("eta0", f"(x - {_num(p['fe'])}) / {_num(radius)}"),
        ("xi", f"xi0 - ({_series(beta, 'sin', 'xi0', 'cosh', 'eta0')})"), ("eta", f"eta0 - ({_series(beta, 'cos', 'xi0', 'sinh', 'eta0')})"),
        ("chi", "asin(sin(xi) / cosh(eta))"),
        ("lon", f"{_num(p['lon0'])} + degrees(atan2(sinh(eta), cos(xi)))"), ("lat", f"degrees(chi + {_series(delta, 'sin', 'chi')})"),
    )


def _laea(p: dict[str, float], back: bool) -> Steps:
    """Lambert azimuthal equal area, oblique or polar, by authalic latitudes."""
    f = 1 / p["rf"]
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) - math.log((1 - e * s) / (1 + e * s)) / (2 * e))
    qp, s0 = q_of(1.0), math.sin(math.radians(p["lat0"]))
    b0, rq = math.asin(q_of(s0) / qp), p["a"] * math.sqrt(qp / 2)
    polar = abs(p["lat0"]) == 90
    d = 1.0 if polar else p["a"] * math.sqrt(1 - s0 * s0) / math.sqrt(1 - e2 * s0 * s0) / (rq * math.cos(b0))
    sb, cb = _num(math.copysign(1.0, b0) if polar else math.sin(b0)), _num(0.0 if polar else math.cos(b0))
    fe, fn = _num(p["fe"]), _num(p["fn"])
    if not back:
        return (
            ("sl", "sin(radians(lat))"), ("dl", f"radians(lon - {_num(p['lon0'])})"),
            ("qq", f"{_num(1 - e2)} * (sl / (1.0e0 - {_num(e2)} * sl * sl) - ln((1.0e0 - {_num(e)} * sl) / (1.0e0 + {_num(e)} * sl)) / {_num(2 * e)})"),
            ("bb", f"asin(greatest(-1.0e0, least(1.0e0, qq / {_num(qp)})))"),
            ("rr", f"{_num(rq)} * sqrt(2.0e0 / greatest(1.0e-15, 1.0e0 + {sb} * sin(bb) + {cb} * cos(bb) * cos(dl)))"),
            ("x", f"{fe} + rr * {_num(d)} * cos(bb) * sin(dl)"), ("y", f"{fn} + rr / {_num(d)} * ({cb} * sin(bb) - {sb} * cos(bb) * cos(dl))"),
        )
    series = [e2 / 3 + 31 * e2**2 / 180 + 517 * e2**3 / 5040, 23 * e2**2 / 360 + 251 * e2**3 / 3780, 761 * e2**3 / 45360]
    return (
        ("xr", f"(x - {fe}) / {_num(d)}"), ("yr", f"(y - {fn}) * {_num(d)}"),
        ("rho", "greatest(1.0e-9, sqrt(xr * xr + yr * yr))"), ("cc", f"2.0e0 * asin(least(1.0e0, rho / {_num(2 * rq)}))"),
        ("bb", f"asin(greatest(-1.0e0, least(1.0e0, cos(cc) * {sb} + yr * sin(cc) * {cb} / rho)))"),
        ("lon", f"{_num(p['lon0'])} + degrees(atan2(xr * sin(cc), rho * {cb} * cos(cc) - yr * {sb} * sin(cc)))"),
        ("lat", f"degrees(bb + {_series(series, 'sin', 'bb')})"),
    )


def _webmerc(p: dict[str, float], back: bool) -> Steps:
    a = _num(p["a"])
    if back:
        return (("lon", f"degrees(x / {a})"), ("lat", f"degrees(2.0e0 * atan(exp(y / {a})) - {_num(math.pi / 2)})"))
    return (("x", f"{a} * radians(lon)"), ("y", f"{a} * ln(tan({_num(math.pi / 4)} + radians(lat) / 2.0e0))"))


def _lcc(p: dict[str, float], back: bool) -> Steps:
    """Lambert conformal conic with two standard parallels."""
    f = 1 / p["rf"]
    e2 = f * (2 - f)
    e = math.sqrt(e2)
    t_of = lambda v: math.tan(math.pi / 4 - v / 2) / ((1 - e * math.sin(v)) / (1 + e * math.sin(v))) ** (e / 2)
    m_of = lambda v: math.cos(v) / math.sqrt(1 - e2 * math.sin(v) ** 2)
    v0, v1, v2 = (math.radians(p[k]) for k in ("lat0", "lat1", "lat2"))
    n = math.sin(v1) if v1 == v2 else (math.log(m_of(v1)) - math.log(m_of(v2))) / (math.log(t_of(v1)) - math.log(t_of(v2)))
    scale = p["a"] * m_of(v1) / (n * t_of(v1) ** n)
    r0, fe, fn = scale * t_of(v0) ** n, _num(p["fe"]), _num(p["fn"])
    if not back:
        return (
            ("sl", f"{_num(e)} * sin(radians(lat))"),
            ("tt", f"tan({_num(math.pi / 4)} - radians(lat) / 2.0e0) / pow((1.0e0 - sl) / (1.0e0 + sl), {_num(e / 2)})"),
            ("rr", f"{_num(scale)} * pow(tt, {_num(n)})"), ("dl", f"lon - {_num(p['lon0'])}"), ("th", f"{_num(n)} * radians({_wrapped('dl')})"),
            ("x", f"{fe} + rr * sin(th)"), ("y", f"{fn} + {_num(r0)} - rr * cos(th)"),
        )
    sign = math.copysign(1.0, n)
    series = _conformal_series(e2)
    return (
        ("xr", f"{_num(sign)} * (x - {fe})"), ("yr", f"{_num(sign)} * ({_num(r0)} - (y - {fn}))"),
        ("tt", f"pow(sqrt(xr * xr + yr * yr) / {_num(abs(scale))}, {_num(1 / n)})"), ("chi", f"{_num(math.pi / 2)} - 2.0e0 * atan(tt)"),
        ("lon", f"{_num(p['lon0'])} + degrees(atan2(xr, yr) / {_num(n)})"), ("lat", f"degrees(chi + {_series(series, 'sin', 'chi')})"),
    )


def _eccentricity2(p: dict[str, float]) -> float:
    return (2 - 1 / p["rf"]) / p["rf"]


def _conformal_series(e2: float) -> list[float]:
    """Coefficients of the sines that lead from conformal to geodetic latitudes."""
    e4, e6, e8 = e2**2, e2**3, e2**4
    return [e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280]


def _rotated(p: dict[str, float], back: bool) -> Steps:
    """Longitude and latitude on a sphere turned about the axis in the equator, a quarter ahead of the meridian opposite to the pole's."""
    turn = math.radians(90 - p["pole_lat"])
    c, s, lon0, own = _num(math.cos(turn)), _num(math.sin(turn)), _num(p["pole_lon"] + 180), _num(p.get("grid_lon", 0.0))
    xyz = lambda lon, lat: (("px", f"cos(radians({lat})) * cos({lon})"), ("py", f"cos(radians({lat})) * sin({lon})"), ("pz", f"sin(radians({lat}))"))
    angle = lambda z: f"degrees(asin(greatest(-1.0e0, least(1.0e0, {z}))))"
    if not back:
        return (("dl", f"radians(lon - {lon0})"), *xyz("dl", "lat"), ("x", _wrapped(f"{own} + degrees(atan2(py, {c} * px + {s} * pz))")), ("y", angle(f"{c} * pz - {s} * px")))
    return (("dl", f"radians(x - {own})"), *xyz("dl", "y"), ("lon", f"{lon0} + degrees(atan2(py, {c} * px - {s} * pz))"), ("lat", angle(f"{c} * pz + {s} * px")))


def _stere(p: dict[str, float], back: bool) -> Steps:
    """Polar stereographic, true to scale at a parallel or scaled at the pole."""
    e2 = _eccentricity2(p)
    e, side = math.sqrt(e2), math.copysign(1.0, p["lat0"])
    v1 = math.radians(abs(p["lat1"]))
    if abs(p["lat1"]) == 90:
        scale = 2 * p["a"] * p["k0"] / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
    else:
        t1 = math.tan(math.pi / 4 - v1 / 2) / ((1 - e * math.sin(v1)) / (1 + e * math.sin(v1))) ** (e / 2)
        scale = p["a"] * p["k0"] * math.cos(v1) / math.sqrt(1 - e2 * math.sin(v1) ** 2) / t1
    fe, fn, sign = _num(p["fe"]), _num(p["fn"]), _num(side)
    if not back:
        return (
            ("vv", f"{sign} * radians(lat)"), ("sl", f"{_num(e)} * sin(vv)"), ("tt", f"tan({_num(math.pi / 4)} - vv / 2.0e0) / pow((1.0e0 - sl) / (1.0e0 + sl), {_num(e / 2)})"),
            ("dl", f"radians(lon - {_num(p['lon0'])})"), ("x", f"{fe} + {_num(scale)} * tt * sin(dl)"), ("y", f"{fn} - {sign} * {_num(scale)} * tt * cos(dl)"),
        )
    return (
        ("xr", f"x - {fe}"), ("yr", f"{sign} * ({fn} - y)"), ("chi", f"{_num(math.pi / 2)} - 2.0e0 * atan(sqrt(xr * xr + yr * yr) / {_num(scale)})"),
        ("lon", f"{_num(p['lon0'])} + degrees(atan2(xr, yr))"), ("lat", f"{sign} * degrees(chi + {_series(_conformal_series(e2), 'sin', 'chi')})"),
    )


def _aea(p: dict[str, float], back: bool) -> Steps:
    """Albers equal area conic with two standard parallels, by authalic latitudes."""
    e2 = _eccentricity2(p)
    e = math.sqrt(e2)
    q_of = lambda s: (1 - e2) * (s / (1 - e2 * s * s) + math.atanh(e * s) / e)
    m2_of = lambda s: (1 - s * s) / (1 - e2 * s * s)
    s0, s1, s2 = (math.sin(math.radians(p[k])) for k in ("lat0", "lat1", "lat2"))
    n = s1 if s1 == s2 else (m2_of(s1) - m2_of(s2)) / (q_of(s2) - q_of(s1))
    c = m2_of(s1) + n * q_of(s1)
    r0 = p["a"] * math.sqrt(c - n * q_of(s0)) / n
    fe, fn = _num(p["fe"]), _num(p["fn"])
    if not back:
        return (
            ("sl", "sin(radians(lat))"), ("qq", f"{_num(1 - e2)} * (sl / (1.0e0 - {_num(e2)} * sl * sl) + atanh({_num(e)} * sl) / {_num(e)})"),
            ("rr", f"{_num(p['a'] / n)} * sqrt(greatest(0.0e0, {_num(c)} - {_num(n)} * qq))"), ("dl", f"lon - {_num(p['lon0'])}"), ("th", f"{_num(n)} * radians({_wrapped('dl')})"),
            ("x", f"{fe} + rr * sin(th)"), ("y", f"{fn} + {_num(r0)} - rr * cos(th)"),
        )
    f = 1 / p["rf"]
    t = f / (2 - f)
    series = [4 * t / 3 + 4 * t**2 / 45 - 16 * t**3 / 35 - 2582 * t**4 / 14175, 46 * t**2 / 45 + 152 * t**3 / 945 - 11966 * t**4 / 14175, 3044 * t**3 / 2835 + 3802 * t**4 / 14175, 6059 * t**4 / 4725]
    sign = _num(math.copysign(1.0, n))
    return (
        ("xr", f"{sign} * (x - {fe})"), ("yr", f"{sign} * ({_num(r0)} - (y - {fn}))"), ("qq", f"({_num(c)} - {_num((n / p['a']) ** 2)} * (xr * xr + yr * yr)) / {_num(n * q_of(1.0))}"),
        ("bb", "asin(greatest(-1.0e0, least(1.0e0, qq)))"), ("lon", f"{_num(p['lon0'])} + degrees(atan2(xr, yr) / {_num(n)})"), ("lat", f"degrees(bb + {_series(series, 'sin', 'bb')})"),
    )


def _sinu(p: dict[str, float], back: bool) -> Steps:
    """Sinusoidal, on an ellipsoid or a sphere (of infinite inverse flattening)."""
    e2, f = _eccentricity2(p), 1 / p["rf"]
    n = f / (2 - f)
    radius = p["a"] / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    arc = [-3 * n / 2 + 9 * n**3 / 16, 15 * n**2 / 16 - 15 * n**4 / 32, -35 * n**3 / 48, 315 * n**4 / 512]
    foot = [3 * n / 2 - 27 * n**3 / 32, 21 * n**2 / 16 - 55 * n**4 / 32, 151 * n**3 / 96, 1097 * n**4 / 512]
    fe, fn, width = _num(p["fe"]), _num(p["fn"]), f"cos(vv) / sqrt(1.0e0 - {_num(e2)} * sin(vv) * sin(vv))"
    if not back:
        return (
            ("vv", "radians(lat)"), ("dl", f"lon - {_num(p['lon0'])}"), ("x", f"{fe} + {_num(p['a'])} * radians({_wrapped('dl')}) * {width}"),
            ("y", f"{fn} + {_num(radius)} * (vv + {_series(arc, 'sin', 'vv')})"),
        )
    return (
        ("mu", f"(y - {fn}) / {_num(radius)}"), ("vv", f"mu + {_series(foot, 'sin', 'mu')}"),
        ("lon", f"{_num(p['lon0'])} + degrees((x - {fe}) / ({_num(p['a'])} * greatest(1.0e-12, {width})))"), ("lat", "degrees(vv)"),
    )


def _merc(p: dict[str, float], back: bool) -> Steps:
    """Mercator on the ellipsoid."""
    e2 = _eccentricity2(p)
    e, scale, fe, fn = math.sqrt(e2), _num(p["a"] * p["k0"]), _num(p["fe"]), _num(p["fn"])
    if not back:
        return (
            ("dl", f"lon - {_num(p['lon0'])}"), ("sl", f"{_num(e)} * sin(radians(lat))"), ("x", f"{fe} + {scale} * radians({_wrapped('dl')})"),
            ("y", f"{fn} + {scale} * (ln(tan({_num(math.pi / 4)} + radians(lat) / 2.0e0)) - {_num(e)} * atanh(sl))"),
        )
    return (
        ("chi", f"{_num(math.pi / 2)} - 2.0e0 * atan(exp(({fn} - y) / {scale}))"), ("lon", f"{_num(p['lon0'])} + degrees((x - {fe}) / {scale})"),
        ("lat", f"degrees(chi + {_series(_conformal_series(e2), 'sin', 'chi')})"),
    )


#: What is added to the coordinates of places that a view from space doesn't see, so that they lie in no grid.
UNSEEN = 1e12


def _geos(p: dict[str, float], back: bool) -> Steps:
    """The view of a geostationary satellite: scan angles times its height, of the axis that it sweeps first.

    Places out of view, and angles past the Earth, get coordinates far from all others.
    """
    e2 = _eccentricity2(p)
    a, far, h = p["a"], p["a"] + p["height"], _num(p["height"])
    fe, fn, d = _num(p["fe"]), _num(p["fn"]), _num(far)
    sees_x = bool(p["sweep_x"])
    flag = lambda test: f"ceil(greatest(0.0e0, least(1.0e0, {test})))"
    if not back:
        across = "atan(py / sqrt(qx * qx + pz * pz))" if sees_x else "atan(py / qx)"
        up = "atan(pz / qx)" if sees_x else "atan(pz / sqrt(qx * qx + py * py))"
        return (
            ("sl", "sin(radians(lat))"), ("dl", f"radians(lon - {_num(p['lon0'])})"), ("nn", f"{_num(a)} / sqrt(1.0e0 - {_num(e2)} * sl * sl)"),
            ("px", "nn * cos(radians(lat)) * cos(dl)"), ("py", "nn * cos(radians(lat)) * sin(dl)"), ("pz", f"{_num(1 - e2)} * nn * sl"), ("qx", f"{d} - px"),
            # A place is seen where the upright there points towards the satellite.
            ("hid", flag(f"{_num(a * a / far)} - px")), ("x", f"{fe} + {h} * {across} + {_num(UNSEEN)} * hid"), ("y", f"{fn} + {h} * {up} + {_num(UNSEEN)} * hid"),
        )
    first = f"tan((x - {fe}) / {h})", f"tan((y - {fn}) / {h})"
    rays = (("vz", first[1]), ("vy", f"{first[0]} * sqrt(1.0e0 + vz * vz)")) if sees_x else (("vy", first[0]), ("vz", f"{first[1]} * sqrt(1.0e0 + vy * vy)"))
    return (
        *rays, ("qa", f"1.0e0 + vy * vy + vz * vz / {_num(1 - e2)}"), ("det", f"{_num(far * far)} - qa * {_num(far * far - a * a)}"), ("hid", flag("-det")),
        ("kk", f"({d} - sqrt(greatest(0.0e0, det))) / qa"), ("px", f"{d} - kk"), ("py", "kk * vy"), ("pz", "kk * vz"),
        ("lon", f"{_num(p['lon0'])} + degrees(atan2(py, px))"), ("lat", f"degrees(atan(pz / ({_num(1 - e2)} * sqrt(px * px + py * py)))) + {_num(UNSEEN)} * hid"),
    )


def _geocentric(ellipsoid: tuple[float, float]) -> Steps:
    """From lon, lat on an ellipsoid's surface to gx, gy, gz."""
    a, e2 = ellipsoid[0], (2 - 1 / ellipsoid[1]) / ellipsoid[1]
    return (
        ("sl", "sin(radians(lat))"), ("nn", f"{_num(a)} / sqrt(1.0e0 - {_num(e2)} * sl * sl)"), ("gx", "nn * cos(radians(lat)) * cos(radians(lon))"),
        ("gy", "nn * cos(radians(lat)) * sin(radians(lon))"), ("gz", f"{_num(1 - e2)} * nn * sl"),
    )


def _geodetic(ellipsoid: tuple[float, float], rounds: int = 4) -> Steps:
    """From gx, gy, gz near an ellipsoid's surface to lon, lat; each round makes the latitude's error some hundred times smaller."""
    a, e2 = ellipsoid[0], (2 - 1 / ellipsoid[1]) / ellipsoid[1]
    steps = [("lon", "degrees(atan2(gy, gx))"), ("pp", "sqrt(gx * gx + gy * gy)"), ("vv", f"atan2(gz, {_num(1 - e2)} * pp)")]
    steps += [("vv", f"atan2(gz + {_num(e2 * a)} * sin(vv) / sqrt(1.0e0 - {_num(e2)} * sin(vv) * sin(vv)), pp)")] * rounds
    return (*steps, ("lat", "degrees(vv)"))


def _shifted(shifts: tuple[float, ...], back: bool) -> Steps:
    """Steps from lon, lat of a datum to those of WGS 84, or back, by seven parameters."""
    own = shifts[:2]
    tx, ty, tz = shifts[2:5]
    rx, ry, rz = (math.radians(v / 3600) for v in shifts[5:8])
    m = 1 + shifts[8] * 1e-6
    rows = [[m, -rz * m, ry * m], [rz * m, m, -rx * m], [-ry * m, rx * m, m]]
    if back:
        (a, b, c), (d, e, f), (g, h, i) = rows
        det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
        rows = [[v / det for v in row] for row in ((e * i - f * h, c * h - b * i, b * f - c * e), (f * g - d * i, a * i - c * g, c * d - a * f), (d * h - e * g, b * g - a * h, a * e - b * d))]
        before, after = [f"({n} - {_num(t)})" for n, t in zip(("gx", "gy", "gz"), (tx, ty, tz), strict=True)], (0.0, 0.0, 0.0)
    else:
        before, after = ["gx", "gy", "gz"], (tx, ty, tz)
    moved = [f"{_num(t)} + " + " + ".join(f"{_num(v)} * {n}" for v, n in zip(row, before, strict=True)) for row, t in zip(rows, after, strict=True)]
    turned = (("hx", moved[0]), ("hy", moved[1]), ("hz", moved[2]), ("gx", "hx"), ("gy", "hy"), ("gz", "hz"))
    return (*_geocentric(WGS84 if back else own), *turned, *_geodetic(own if back else WGS84))


def transformation(source: CRS, target: CRS) -> Steps:
    """Steps that take x, y in the source system to x, y in the target system."""
    if source.agrees(target):
        return ()
    between: Steps = ()
    if source.shifts != target.shifts:
        between = (_shifted(source.shifts, False) if source.shifts else ()) + (_shifted(target.shifts, True) if target.shifts else ())
    return source.inverse() + between + target.forward()


def project(df: DataFrame, source: CRS, target: CRS, x: str = "x", y: str = "y") -> DataFrame:
    """df with columns x and y taken from the source system to the target system; other columns stay."""
    own = [c for c in df.columns if c not in (x, y)]
    held = {c: f"_held_{i}" for i, c in enumerate(own)}
    out = df.select(*(F.col(c).alias(h) for c, h in held.items()), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"))
    for name, text in transformation(source, target):
        out = out.withColumn(name, F.expr(text))
    order = [F.col("x").alias(x) if c == x else F.col("y").alias(y) if c == y else F.col(held[c]).alias(c) for c in df.columns]
    return out.select(*order)


def project_point(source: CRS, target: CRS, x: float, y: float) -> tuple[float, float]:
    """One point, worked out on the driver."""
    names: dict[str, float] = {"x": x, "y": y}
    for name, text in transformation(source, target):
        names[name] = eval(text, {"__builtins__": {}}, {**_FUNCTIONS, **names})  # noqa: S307  expressions are this module's own
    return names["x"], names["y"]


def project_bounds(source: CRS, target: CRS, bbox: tuple[float, float, float, float], between: int = 21) -> tuple[float, float, float, float]:
    """The bounding box in the target system of a box whose edges carry `between` points besides corners.

    Longitudes of a box in another system run on across 180 degrees (170 to 190, say); a box that holds a pole reaches
    to it and has all longitudes, from -180 to 180.
    """
    x0, y0, x1, y1 = bbox
    steps = [k / (between + 1) for k in range(between + 2)]
    across, up = [x0 + (x1 - x0) * t for t in steps], [y0 + (y1 - y0) * t for t in steps]
    ring = [(x, y0) for x in across] + [(x1, y) for y in up] + [(x, y1) for x in reversed(across)] + [(x0, y) for y in reversed(up)]
    points = [project_point(source, target, x, y) for x, y in ring]
    xs, ys = zip(*points, strict=True)
    if not target.is_geographic or source.agrees(target):
        return min(xs), min(ys), max(xs), max(ys)
    on = [xs[0]]
    for x in xs[1:]:
        on.append(on[-1] + (x - on[-1] + 180) % 360 - 180)
    poles = [lat for lat in (90.0, -90.0) if _holds(bbox, source, target, lat)]
    shift = 360 * math.floor(((min(on) + max(on)) / 2 + 180) / 360)
    low, high = (-180.0, 180.0) if poles or max(on) - min(on) >= 360 else (min(on) - shift, max(on) - shift)
    return low, min(*ys, *poles), high, max(*ys, *poles)


def _holds(bbox: tuple[float, float, float, float], crs: CRS, target: CRS, lat: float) -> bool:
    """Whether a box of a system holds the pole of this latitude of a geographic target system."""
    try:
        x, y = project_point(target, crs, dict(crs.parameters).get("lon0", 0.0), math.copysign(abs(lat) - 1e-7, lat))
        back = project_point(crs, target, x, y)
    except (ArithmeticError, ValueError):
        return False
    return bbox[0] <= x <= bbox[2] and bbox[1] <= y <= bbox[3] and abs(back[1] - lat) < 1e-3


def sql_of(steps: Steps, source: str, keep: str = "*") -> str:
    """A query that applies steps to the rows of `source`, one nested select for each."""
    seen = {"x", "y"}
    for name, text in steps:
        replaced = f"EXCLUDE ({name})" if name in seen else ""
        seen.add(name)
        source = f"(SELECT * {replaced}, {text} AS {name} FROM {source})"
    return f"SELECT {keep} FROM {source}"
