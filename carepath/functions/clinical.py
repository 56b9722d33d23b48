"""Column functions of the clinical rules: kidney function, categories, cutoffs, censored comparisons, ages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def ckd_epi_2021(creatinine: Column, age: Column, female: Column) -> Column:
    """eGFR in mL/min/1.73 m2 from creatinine in mg/dL (CKD-EPI 2021, published equation)."""
    kappa, alpha = F.when(female, 0.7).otherwise(0.9), F.when(female, -0.241).otherwise(-0.302)
    ratio = creatinine.cast("double") / kappa
    return 142 * F.pow(F.least(ratio, F.lit(1.0)), alpha) * F.pow(F.greatest(ratio, F.lit(1.0)), F.lit(-1.2)) * F.pow(F.lit(0.9938), age) * F.when(female, 1.012).otherwise(1.0)


def mdrd_2006(creatinine: Column, age: Column, female: Column) -> Column:
    return 175 * F.pow(creatinine.cast("double"), F.lit(-1.154)) * F.pow(age.cast("double"), F.lit(-0.203)) * F.when(female, 0.742).otherwise(1.0)


def whole(value: Column) -> Column:
    """Rounded half up to an integer."""
    return F.floor(value + 0.5).cast("int")


def gfr_category(whole_egfr: Column) -> Column:
    return F.when(whole_egfr >= 90, "G1").when(whole_egfr >= 60, "G2").when(whole_egfr >= 45, "G3a").when(whole_egfr >= 30, "G3b").when(whole_egfr >= 15, "G4").when(whole_egfr.isNotNull(), "G5")


def albuminuria_category(acr: Column) -> Column:
    return F.when(acr < 30, "A1").when(acr <= 300, "A2").when(acr.isNotNull(), "A3")


def at_least(value: Column, comparator: Column, cutoff: Column | float) -> Column:
    """Whether a measured value, perhaps censored, is at the cutoff or above; null where it cannot be told."""
    c = F.coalesce(comparator, F.lit(""))
    return (
        F.when(c == "", value >= cutoff)
        .when(c.isin(">", ">="), F.when(value >= cutoff, True))
        .when(c == "<", F.when(value <= cutoff, False))
        .when(c == "<=", F.when(value < cutoff, False))
    )


def below(value: Column, comparator: Column, cutoff: Column | float) -> Column:
    return ~at_least(value, comparator, cutoff)


def completed_months(birth: Column, day: Column) -> Column:
    """Calendar months lived, by the day of the month (29 February to 28 February a year on is 11)."""
    return (F.year(day) - F.year(birth)) * 12 + F.month(day) - F.month(birth) - F.when(F.dayofmonth(day) < F.dayofmonth(birth), 1).otherwise(0)


def completed_years(birth: Column, day: Column) -> Column:
    return F.floor(completed_months(birth, day) / 12).cast("int")


def haemoglobin_cutoffs(age_months: Column, female: Column, pregnant: Column) -> Column:
    """The cutoffs in g/L that apply (three in pregnancy), or null where none is defined.

    Fixed values: the published haemoglobin cutoffs by age and sex.
    """
    years = F.floor(age_months / 12)
    one = lambda x: F.array(F.lit(x))
    return (
        F.when(pregnant, F.array(F.lit(110), F.lit(105), F.lit(110)))
        .when(age_months < 6, F.lit(None))
        .when(age_months < 24, one(105))
        .when(age_months < 60, one(110))
        .when(years < 12, one(115))
        .when(years < 15, one(120))
        .when(years <= 65, F.when(female, one(120)).when(~female, one(130)))
    )


def months_before(day: Column, months: int) -> Column:
    """The same day `months` earlier, at the end of a shorter month."""
    return F.add_months(day, -months)


def age_band(years: Column) -> Column:
    """Bands of twelve years from 18, all younger and all from 90 together; null for an unknown age."""
    low = (F.floor((years - 18) / 12) * 12 + 18).cast("int")
    return F.when(years < 18, "0-17").when(years >= 90, "90+").when(years.isNotNull(), F.concat_ws("-", low, low + 11))
