"""Radiometric scalars of an image: noise-equivalent and calibrated levels, SNR, pair geometry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.geodesy import C


def nesz(noise_psd: Column, bandwidth_area: Column, samples: Column, reference_power: Column, gain: Column) -> Column:
    """Noise-equivalent sigma zero."""
    return noise_psd * bandwidth_area / (samples * reference_power * gain)


def snr(gain: Column, nesz_reference: Column, sigma0: Column, ambiguous_gain: Column, inside: Column) -> Column:
    """Signal over noise and ambiguities; zero outside the swath."""
    return F.when(inside, gain / (nesz_reference / sigma0 + ambiguous_gain)).otherwise(0.0)


def calibrated(power: Column, clutter_gain: Column, reference_power: Column, slope: Column, graze: Column) -> dict[str, Column]:
    """sigma0, beta0 and gamma0 of a pixel power; angles in degrees."""
    sigma0 = power / (clutter_gain * reference_power)
    return {"sigma0": sigma0, "beta0": sigma0 / F.cos(F.radians(slope)), "gamma0": sigma0 / F.sin(F.radians(graze))}


def pair_geometry(fc: Column, bandwidth: Column, graze_a: Column, graze_b: Column) -> dict[str, Column]:
    """Shares of the range spectrum, critical difference of grazing angle (degrees) and height of ambiguity (m) of two collections."""
    ra, rb = F.radians(graze_a), F.radians(graze_b)
    lo = F.greatest((fc - bandwidth / 2) * F.cos(ra), (fc - bandwidth / 2) * F.cos(rb))
    hi = F.least((fc + bandwidth / 2) * F.cos(ra), (fc + bandwidth / 2) * F.cos(rb))
    slope = F.tan(ra) - F.tan(rb)
    rho = (lo + hi) / C
    return {
        "overlap": F.greatest(hi - lo, F.lit(0.0)) / (bandwidth * F.cos(ra)),
        "critical_graze": F.degrees(bandwidth / fc / F.tan((ra + rb) / 2)),
        "height_of_ambiguity": F.when(F.abs(slope) > 1e-12, 1 / (rho * F.when(F.abs(slope) > 1e-12, slope).otherwise(1.0))),
    }
