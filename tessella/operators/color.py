"""Colour arithmetic: HSL to hex, luminance, contrast and derived palettes, as columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WHITE, DARK = "#ffffff", "#111418"
BODY_CONTRAST = 4.5


def _lit(v: Column | float | str) -> Column:
    return v if isinstance(v, Column) else F.lit(v)


def hsl_to_hex(hue: Column | float, saturation: Column | float, lightness: Column | float) -> Column:
    """#rrggbb of hue in degrees, saturation and lightness from 0 to 1; channels round half to even."""
    h, s, light = (_lit(x).cast("double") for x in (hue, saturation, lightness))
    reach = s * F.least(light, 1 - light)

    def channel(n: int) -> Column:
        k = F.pmod(n + h / 30, F.lit(12.0))
        value = light - reach * F.greatest(F.lit(-1.0), F.least(k - 3, 9 - k, F.lit(1.0)))
        # Sums that differ in the last bits must not decide a half.
        return F.lpad(F.lower(F.hex(F.bround(F.round(value * 255, 9), 0).cast("long"))), 2, "0")

    return F.concat(F.lit("#"), channel(0), channel(8), channel(4))


def luminance(colour: Column | str) -> Column:
    """Relative luminance of #rrggbb."""
    digits = F.ltrim(_lit(colour), F.lit("#"))

    def linear(at: int) -> Column:
        c = F.conv(F.substring(digits, at, 2), 16, 10).cast("double") / 255
        return F.when(c <= 0.03928, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, F.lit(2.4)))

    return 0.2126 * linear(1) + 0.7152 * linear(3) + 0.0722 * linear(5)


def contrast(a: Column | str, b: Column | str) -> Column:
    """Contrast ratio of two colours, from 1 to 21, to 2 places; symmetric."""
    x, y = luminance(a), luminance(b)
    return F.round((F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05), 2)


def palette(seeds: DataFrame) -> DataFrame:
    """seeds (industry, mood, hue, sat, light) with the derived colours and their contrasts."""
    hue, sat, light = F.col("hue"), F.col("sat"), F.col("light")
    # Shifts and levels by which a palette follows from its seed.
    colours = {
        "primary": hsl_to_hex(hue, sat, light),
        "secondary": hsl_to_hex(hue + 28, F.greatest(F.lit(0.0), sat - 0.12), F.least(F.lit(0.92), light + 0.06)),
        "accent": hsl_to_hex(hue + 165, F.least(F.lit(0.95), sat + 0.10), 0.55),
        "bg": hsl_to_hex(hue, 0.16, 0.985),
        "surface": hsl_to_hex(hue, 0.14, 0.955),
        "text": hsl_to_hex(hue, 0.22, 0.16),
        "success": hsl_to_hex(145, 0.55, 0.40),
        "warning": hsl_to_hex(38, 0.85, 0.50),
        "error": hsl_to_hex(2, 0.70, 0.48),
    }
    rows = seeds.withColumns(colours)
    on_white, on_dark = contrast(WHITE, F.col("primary")), contrast(DARK, F.col("primary"))
    rows = rows.withColumns({
        "text_on_bg_contrast": contrast(F.col("text"), F.col("bg")),
        "primary_on_bg_contrast": contrast(F.col("primary"), F.col("bg")),
        "on_primary": F.when(on_white >= on_dark, WHITE).otherwise(DARK),
        "on_primary_contrast": F.greatest(on_white, on_dark),
    })
    aa = F.when(F.col("text_on_bg_contrast") >= BODY_CONTRAST, "pass").otherwise("fail")
    first_mood = F.element_at(F.split("mood", "-"), 1)
    return rows.withColumns({"aa_body_text": aa, "name": F.concat_ws("-", "industry", "mood"), "tags": F.concat_ws(";", "industry", first_mood, F.lit("light"), F.lit("generated"))})
