"""Configurable reload of saved wide profiles: labels, scaling, selection, draws, components, split."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from profuse.operators import align, labels, reduce, scale, split
from profuse.operators.small import join_small, settle
from profuse.session import stored


@dataclass
class ProfileRule:
    """What happens to one profile.

    ``repair`` replaces a part of every sample label; ``follows`` keeps the
    samples of the reference profile only; ``select`` keeps features that equal
    ("exact") or hold ("contains") a listed name.
    """

    drop_id: bool = False
    repair: tuple[str, str] | None = None
    follows: bool = False
    select: str | None = None
    threshold: float | None = None


@dataclass
class ProfileReload:
    """Switches of the reload of several profiles; ``names`` is a table (name) for the selecting rules."""

    target: str
    reference: str
    rules: dict[str, ProfileRule] = field(default_factory=dict)
    scaling: str = "zscore"
    names: DataFrame | None = None
    log_target: bool = True
    draws: int | None = None
    components: int | None = None
    test_share: float = 0.2
    seed: int = 10
    strict: bool = False


def wide_cells(profile: str, wide: DataFrame, rule: ProfileRule) -> DataFrame:
    """Cells of a saved table whose first column is the sample label; absent ones stay NULL rows.

    With ``drop_id`` the column after the label, a repeated identifier, is left out.
    """
    label, *values = wide.columns
    values = values[1:] if rule.drop_id else values
    if not values:
        raise ValueError(f"profile {profile} has no feature column")
    sample = F.col(label).cast("string")
    if rule.repair is not None:
        sample = F.replace(sample, F.lit(rule.repair[0]), F.lit(rule.repair[1]))
    typed = wide.select(sample.alias("sample_id"), *[F.col(f"`{c}`").cast("double").alias(c) for c in values])
    return typed.unpivot("sample_id", [f"`{c}`" for c in values], "feature", "value").select(
        F.lit(profile).alias("profile"), "sample_id", "feature", F.when(~F.isnan("value"), F.col("value")).alias("value"))


def _by_profile(rules: dict, take) -> Column:
    """The value ``take(rule)`` of the row's profile; NULL where a rule has none."""
    out = F.lit(None)
    for name, rule in rules.items():
        if take(rule) is not None:
            out = F.when(F.col("profile") == name, F.lit(take(rule))).otherwise(out)
    return out


def chosen_features(cells: DataFrame, options: ProfileReload) -> DataFrame:
    """(profile, feature, centre, width[, draw]) of the features that stay.

    One aggregate over all profiles gives the scaling (from all rows) and the
    variance after scaling (from the rows that stay, marked ``kept``).
    """
    v = F.col("value")
    stats = cells.groupBy("profile", "feature").agg(
        F.min(v).alias("lo"), F.max(v).alias("hi"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("sd"),
        F.var_pop(F.when(F.col("kept"), v)).alias("spread"))
    flat = F.col("lo") == F.col("hi")
    if options.scaling == "zscore":
        centre, width = F.when(flat, F.col("lo")).otherwise(F.col("mean")), F.col("sd")
    elif options.scaling == "minmax":
        centre, width = F.col("lo"), F.col("hi") - F.col("lo")
    else:
        raise ValueError("scaling is 'zscore' or 'minmax'")
    table = settle(stats.filter(F.col("lo").isNotNull()).select(
        "profile", "feature", centre.alias("centre"), F.when(flat | (width == 0.0), 1.0).otherwise(width).alias("width"), "spread"))
    limit = _by_profile(options.rules, lambda rule: rule.threshold)
    variance = F.coalesce(F.col("spread") / (F.col("width") * F.col("width")), F.lit(0.0))
    table = table.filter(limit.isNull() | (variance > limit)).drop("spread")
    kind = _by_profile(options.rules, lambda rule: rule.select)
    if any(rule.select for rule in options.rules.values()):
        if options.names is None:
            raise ValueError("a selecting rule needs a list of names")
        marked = table.withColumn("kind", kind)
        exact = marked.filter(F.col("kind") == "exact").join(options.names.select(F.col("name").alias("feature")).distinct(), "feature", "left_semi")
        inside = align.match_substrings(marked.filter(F.col("kind") == "contains"), options.names).select(marked.columns).distinct()
        table = marked.filter(F.col("kind").isNull()).unionByName(exact).unionByName(inside).drop("kind")
    table = settle(table)
    if options.draws is None:
        return table.withColumn("draw", F.lit(0).cast("bigint"))
    return split.random_features_repeated(table.select("profile", "feature"), options.draws, options.seed).join(table, ["profile", "feature"])


def reload_profiles(wide: dict[str, DataFrame], response: DataFrame, options: ProfileReload) -> DataFrame:
    """(split, profile, sample_id, feature, draw, value, y), or components "pc1", "pc2", ... in place of features.

    Order of the steps: leading identifier off, labels repaired, scaling, name
    lists, alignment to the reference profile, variance, draws with
    replacement, components per profile, split of the reference's samples that
    have a response.  Components read absent cells as zero, the scaled centre
    or minimum; without components absent cells give no row.  Of repeated
    samples the largest value of a feature counts.  With ``strict`` a sample of
    the reference that a following profile lacks is an error.
    """
    rules = {name: options.rules.get(name, ProfileRule()) for name in wide}
    if options.reference not in wide:
        raise KeyError(f"no profile {options.reference}")
    cells = None
    for name, frame in wide.items():
        part = wide_cells(name, frame, rules[name])
        cells = part if cells is None else cells.unionByName(part)
    cells = stored(cells.groupBy("profile", "sample_id", "feature").agg(F.max("value").alias("value")), "profiles")
    leading = cells.filter(F.col("profile") == options.reference).select("sample_id").distinct()
    followers = [name for name, rule in rules.items() if rule.follows and name != options.reference]
    if options.strict:
        for name in followers:
            labels_of = cells.filter(F.col("profile") == name).select("sample_id").distinct()
            align.align_to(leading, labels_of, strict=True)
    known = cells.join(leading.withColumn("led", F.lit(True)), "sample_id", "left")
    marked = known.withColumn("kept", ~F.col("profile").isin(followers) | F.col("led").isNotNull()).drop("led")
    table = chosen_features(marked, options)
    kept = marked.filter("kept").drop("kept")
    if options.components is None:
        scaled = join_small(kept.filter(F.col("value").isNotNull()), table, ["profile", "feature"])
        values = scaled.select("profile", "sample_id", "feature", "draw", ((F.col("value") - F.col("centre")) / F.col("width")).alias("value"))
    else:
        values = profile_components(kept, table, options.components)
    outcome = labels.target(response, options.target).filter(F.col("y").isNotNull()).join(leading, "sample_id", "left_semi")
    if options.log_target:
        outcome = outcome.withColumn("y", scale.log10(F.col("y")))
    parts = split.train_test_ceil(outcome.select("sample_id"), options.seed, options.test_share)
    return values.join(outcome.join(parts, "sample_id"), "sample_id").select("split", "profile", "sample_id", "feature", "draw", "value", "y")


def profile_components(cells: DataFrame, table: DataFrame, n: int) -> DataFrame:
    """Principal components of every profile's chosen features, all from one Gram scan."""
    places = {}
    for name, feature, draw in sorted((r["profile"], r["feature"], r["draw"]) for r in table.select("profile", "feature", "draw").collect()):
        places.setdefault(name, []).append((feature, draw))
    order = [(name, f, d, i) for name, mine in places.items() for i, (f, d) in enumerate(mine)]
    spark = cells.sparkSession
    placed = settle(table.join(spark.createDataFrame(order, "profile string, feature string, draw bigint, place int"), ["profile", "feature", "draw"]))
    scaled = cells.join(placed, ["profile", "feature"], "left").select(
        "profile", "sample_id", "place", ((F.col("value") - F.col("centre")) / F.col("width")).alias("value"))
    found = scaled.groupBy("profile", "sample_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("place").isNotNull() & F.col("value").isNotNull(), F.struct("place", "value")))).alias("at"))
    width = _by_profile({name: len(mine) for name, mine in places.items()}, lambda k: k)
    vectors = stored(found.filter(width.isNotNull()).select(
        "profile", "sample_id", F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.coalesce(F.col("at")[i], F.lit(0.0))).alias("x")), "vectors")
    fits = reduce.fit_pca_by(vectors, "profile", n)
    scores = reduce.transform_by(vectors, fits, "profile")
    return scores.select("profile", "sample_id", F.posexplode("x").alias("k", "value")).select(
        "profile", "sample_id", F.concat(F.lit("pc"), (F.col("k") + 1).cast("string")).alias("feature"), F.lit(0).cast("bigint").alias("draw"), "value")
