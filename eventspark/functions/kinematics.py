"""Kinematic quantities as column expressions. They work on top-level columns and on lambda variables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def pt(px: Column, py: Column) -> Column:
    return F.sqrt(px * px + py * py)


def momentum(px: Column, py: Column, pz: Column) -> Column:
    return F.sqrt(px * px + py * py + pz * pz)


def theta(px: Column, py: Column, pz: Column) -> Column:
    """Polar angle with the cosine clamped to [-1, 1]; 0 for a particle at rest."""
    r = momentum(px, py, pz)
    cosine = F.least(F.greatest(pz / r, F.lit(-1.0)), F.lit(1.0))
    return F.when(r != 0.0, F.acos(cosine)).otherwise(F.lit(0.0))


def phi(px: Column, py: Column) -> Column:
    return F.atan2(py, px)


def eta_from_theta(angle: Column) -> Column:
    """Pseudorapidity of a polar angle; +inf along the beam."""
    return F.when(angle != 0.0, -F.log(F.tan(angle / 2.0))).otherwise(F.lit(INF))


def polar(px: Column, py: Column, pz: Column) -> dict[str, Column]:
    """pt, eta, theta, phi in the analysis convention."""
    angle = theta(px, py, pz)
    return {"pt": pt(px, py), "eta": eta_from_theta(angle), "theta": angle, "phi": phi(px, py)}


def encoder_variables(px: Column, py: Column, pz: Column) -> dict[str, Column]:
    """pt, eta, theta, phi in the encoder convention: eta by asinh, undefined where pt is 0."""
    transverse, r = pt(px, py), momentum(px, py, pz)
    return {
        "pt": transverse,
        "eta": F.when(transverse != 0.0, F.asinh(pz / transverse)),
        "theta": F.when(r != 0.0, F.acos(pz / r)).otherwise(F.lit(0.0)),
        "phi": phi(px, py),
    }


def finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) != INF)


def encodable(e: Column, px: Column, py: Column, pz: Column, eta_limit: float) -> Column:
    """True where the encoder accepts the particle."""
    # a null eta (pt = 0) or an overflow of pz / pt leaves the comparison not true
    eta = encoder_variables(px, py, pz)["eta"]
    return F.coalesce(
        finite(e) & finite(px) & finite(py) & finite(pz) & (F.abs(eta) <= eta_limit), F.lit(False))


def from_pt_eta_phi(mass: Column, transverse: Column, eta: Column, azimuth: Column) -> dict[str, Column]:
    px, py, pz = transverse * F.cos(azimuth), transverse * F.sin(azimuth), transverse * F.sinh(eta)
    return {"e": F.sqrt(mass * mass + px * px + py * py + pz * pz), "px": px, "py": py, "pz": pz}


def from_e_theta_phi(mass: Column, e: Column, angle: Column, azimuth: Column) -> dict[str, Column]:
    """Energies below the mass have no momentum: the square root gives NaN."""
    p = F.sqrt(e * e - mass * mass)
    transverse = p * F.sin(angle)
    return {"e": e, "px": transverse * F.cos(azimuth), "py": transverse * F.sin(azimuth),
            "pz": p * F.cos(angle)}


def four_vector(mass: Column, features: dict[str, Column]) -> dict[str, Column]:
    """Four-vector from whichever complete set of features is there."""
    have = set(features)
    if {"pt", "eta", "phi"} <= have:
        return from_pt_eta_phi(mass, features["pt"], features["eta"], features["phi"])
    if {"e", "theta", "phi"} <= have:
        return from_e_theta_phi(mass, features["e"], features["theta"], features["phi"])
    if {"e", "px", "py", "pz"} <= have:
        return {name: features[name] for name in ("e", "px", "py", "pz")}
    raise ValueError(f"no four-vector can be built from {sorted(have)}")
