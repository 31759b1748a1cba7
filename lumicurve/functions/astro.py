"""Scalar functions of time and sky, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# Latitude and longitude of the observatory in degrees.
SITE = (43.1933116667, -81.3160233333)

UNIX_JD, J2000 = 2440587.5, 2451545.0
#: Sidereal hours per solar hour.
SIDEREAL = 1.0027379


def jd_from_unix(t: Column) -> Column:
    return t / 86400.0 + UNIX_JD


def unix_from_jd(jd: Column) -> Column:
    return (jd - UNIX_JD) * 86400.0


def sidereal_degrees(t: Column, longitude: float = SITE[1]) -> Column:
    """Mean local sidereal time of unix seconds, in degrees (0 to 360)."""
    d = jd_from_unix(t) - J2000
    c = d / 36525.0
    return F.pmod(280.46061837 + 360.98564736629 * d + 0.000387933 * c * c + longitude, F.lit(360.0))


def utc_from_lst(lst_hours: Column, lst_reference: Column, utc_reference: Column) -> Column:
    """Unix seconds of a sidereal time, given a pair that belongs together."""
    return utc_reference + (lst_hours - lst_reference) / SIDEREAL * 3600.0


def horizontal(t: Column, ra: Column, dec: Column, site: tuple[float, float] = SITE) -> dict[str, Column]:
    """alt, az (degrees) and airmass of a position at unix seconds."""
    ha, d, lat = F.radians(sidereal_degrees(t, site[1]) - ra), F.radians(dec), math.radians(site[0])
    alt = F.asin(F.sin(d) * math.sin(lat) + F.cos(d) * math.cos(lat) * F.cos(ha))
    a = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (F.sin(d) - F.sin(alt) * math.sin(lat)) / (F.cos(alt) * math.cos(lat))))))
    return {"alt": F.degrees(alt), "az": F.when(F.sin(ha) < 0, a).otherwise(360.0 - a), "airmass": airmass(F.degrees(alt))}


def airmass(alt: Column) -> Column:
    """1 / cos of the zenith angle."""
    return 1.0 / F.cos(F.radians(90.0 - alt))


def twilight(jd: Column, site: tuple[float, float] = SITE, altitude: float = -12.0) -> dict[str, Column]:
    """rise and set (Julian dates) of the sun passing the altitude, by the sunrise equation."""
    # The coefficients of the public sunrise equation.
    day = F.floor(jd - J2000 + 0.0008) - site[1] / 360.0
    m = F.pmod(357.5291 + 0.98560028 * day, F.lit(360.0))
    r = F.radians(m)
    center = 1.9148 * F.sin(r) + 0.02 * F.sin(2 * r) + 0.0003 * F.sin(3 * r)
    lam = F.radians(F.pmod(m + center + 180.0 + 102.9372, F.lit(360.0)))
    noon = J2000 + day + 0.0053 * F.sin(r) - 0.0069 * F.sin(2 * lam)
    sin_dec = F.sin(lam) * math.sin(math.radians(23.44))
    lat = math.radians(site[0])
    cos_ha = (math.sin(math.radians(altitude)) - math.sin(lat) * sin_dec) / (math.cos(lat) * F.cos(F.asin(sin_dec)))
    half = F.degrees(F.acos(cos_ha)) / 360.0
    return {"rise": noon - half, "set": noon + half}


def tangent_plane(ra: Column, dec: Column, ra0: float, dec0: float) -> dict[str, Column]:
    """Gnomonic coordinates xi, eta (degrees) about a centre."""
    a, d, d0 = F.radians(ra - ra0), F.radians(dec), math.radians(dec0)
    c = math.sin(d0) * F.sin(d) + math.cos(d0) * F.cos(d) * F.cos(a)
    return {"xi": F.degrees(F.cos(d) * F.sin(a) / c), "eta": F.degrees((math.cos(d0) * F.sin(d) - math.sin(d0) * F.cos(d) * F.cos(a)) / c)}


def from_tangent_plane(xi: Column, eta: Column, ra0: float, dec0: float) -> dict[str, Column]:
    """Right ascension and declination of gnomonic coordinates (degrees)."""
    x, y, d0 = F.radians(xi), F.radians(eta), math.radians(dec0)
    below = math.cos(d0) - y * math.sin(d0)
    return {"ra": F.pmod(ra0 + F.degrees(F.atan2(x, below)), F.lit(360.0)), "dec": F.degrees(F.atan((math.sin(d0) + y * math.cos(d0)) / F.sqrt(x * x + below * below)))}


def pixel_to_sky(x: Column, y: Column, wcs: dict[str, float], sip: dict[str, dict[tuple[int, int], float]] | None = None) -> dict[str, Column]:
    """Sky coordinates of pixels under a tangent-plane solution: keys crpix1,
    crpix2, crval1, crval2, cd1_1 .. cd2_2, and SIP polynomials a and b."""
    u, v = x - wcs["crpix1"], y - wcs["crpix2"]
    f, g = u, v
    for name, out in (("a", 0), ("b", 1)):
        for (p, q), coefficient in (sip or {}).get(name, {}).items():
            term = coefficient * F.pow(u, F.lit(p)) * F.pow(v, F.lit(q))
            f, g = (f + term, g) if out == 0 else (f, g + term)
    return from_tangent_plane(wcs["cd1_1"] * f + wcs["cd1_2"] * g, wcs["cd2_1"] * f + wcs["cd2_2"] * g, wcs["crval1"], wcs["crval2"])


def sky_to_pixel(ra: Column, dec: Column, wcs: dict[str, float], sip: dict[str, dict[tuple[int, int], float]] | None = None, rounds: int = 6) -> dict[str, Column]:
    """Pixels of sky coordinates under a tangent-plane solution. With SIP
    polynomials the distortion is taken off in some rounds, each from the place
    found before; small distortions settle in three or four."""
    p = tangent_plane(ra, dec, wcs["crval1"], wcs["crval2"])
    det = wcs["cd1_1"] * wcs["cd2_2"] - wcs["cd1_2"] * wcs["cd2_1"]
    f = (wcs["cd2_2"] * p["xi"] - wcs["cd1_2"] * p["eta"]) / det
    g = (wcs["cd1_1"] * p["eta"] - wcs["cd2_1"] * p["xi"]) / det
    if not sip:
        return {"x": wcs["crpix1"] + f, "y": wcs["crpix2"] + g}

    def part(name: str, u: Column, v: Column) -> Column:
        return sum((c * F.pow(u, F.lit(m)) * F.pow(v, F.lit(n)) for (m, n), c in sip.get(name, {}).items()), F.lit(0.0))

    # The rounds are an aggregate over a sequence, so that the expression does not double with each.
    start = F.struct(f.alias("u"), g.alias("v"), f.alias("f"), g.alias("g"))
    step = lambda s, _: F.struct((s["f"] - part("a", s["u"], s["v"])).alias("u"), (s["g"] - part("b", s["u"], s["v"])).alias("v"), s["f"].alias("f"), s["g"].alias("g"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, step)
    return {"x": wcs["crpix1"] + found["u"], "y": wcs["crpix2"] + found["v"]}


def magnitude(flux: Column) -> Column:
    """-2.5 log10 of a positive flux, null otherwise."""
    return F.when(flux > 0, -2.5 * F.log10(flux))


def transverse_velocity(distance_au: Column, earth: float = 29800.0) -> Column:
    return earth * (1 - F.sqrt(1.0 / distance_au))


def stellar_radius(diameter_mas: Column, distance: Column) -> Column:
    """Projected radius of a star's disc (of so many milliarcseconds) at a distance."""
    return distance * F.tan(diameter_mas / 206265000.0 / 2.0)


def fresnel_units(x: Column, wavelength: Column, distance: Column) -> Column:
    return x / F.sqrt(wavelength * distance / 2.0)


def round_odd(x: Column) -> Column:
    """The nearest odd integer at or below the ceiling."""
    return F.ceil(x) - F.when(F.pmod(F.ceil(x), F.lit(2)) == 0, 1).otherwise(0)
