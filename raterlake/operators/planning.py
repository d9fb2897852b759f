"""Trial plans, panel designs, cost estimates and media limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ids, seeds
from ..schema import MONEY, TRAITS

#: The generated trait of each fraction and the traits it is the product of.
GENERATORS: dict[str, list[tuple[str, tuple[str, ...]]]] = {
    "1": [],
    "1/2": [("neuroticism", ("openness", "conscientiousness", "extraversion", "agreeableness"))],
    "1/4": [("agreeableness", ("openness", "conscientiousness")), ("neuroticism", ("openness", "extraversion"))],
}


def canonical_shapes(clips: DataFrame, instruments: DataFrame) -> DataFrame:
    """The trials of one session before they are shuffled: instrument, clip_ids, pair_id,
    position, and place in the canonical order.

    clips: clip_id, pos. instruments: instrument, pairwise, self_report, pos. Unordered pairs
    come from the explosion of the ordered clip list of the test, bounded by its length."""
    listed = clips.agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "clip_id"))), lambda x: x["clip_id"]).alias("clips"))
    base = instruments.crossJoin(listed)
    none = F.lit(None).cast("string")
    shape = lambda c, p, o: F.struct(c.alias("clip_ids"), p.alias("pair_id"), o.cast("int").alias("position"))
    single = F.transform("clips", lambda c: shape(F.array(c), none, F.lit(None)))

    def both(a: Column, b: Column) -> Column:
        lo, hi = F.least(a, b), F.greatest(a, b)
        pid = F.concat_ws(":", F.col("instrument"), lo, hi)
        return F.array(shape(F.array(lo, hi), pid, F.lit(1)), shape(F.array(hi, lo), pid, F.lit(2)))

    pairs = F.flatten(F.flatten(F.transform("clips", lambda a, i: F.transform(F.slice("clips", i + 2, F.size("clips")), lambda b: both(a, b)))))
    empty = F.array(shape(F.array().cast("array<string>"), none, F.lit(None)))
    rows = base.select("instrument", F.col("pos").alias("ipos"), F.posexplode(F.when(F.col("self_report"), empty).when(F.col("pairwise"), pairs).otherwise(single)).alias("cpos", "s"))
    rows = rows.select("instrument", "s.clip_ids", "s.pair_id", "s.position", "ipos", "cpos")
    return rows.withColumn("place", F.row_number().over(Window.orderBy("ipos", "cpos")) - 1).drop("ipos", "cpos")


def sessions(test: str, personas: DataFrame, models: DataFrame, repeats: int, study_seed: int) -> DataFrame:
    """persona × model × repeat with session_id and order_seed. A plan is this product; the
    models of a study are a short list, so it is sent to the personas."""
    s = personas.select(F.col("id").alias("persona_id")).crossJoin(F.broadcast(models.select("model_id", F.col("pos").alias("model_pos"))))
    s = s.select("*", F.explode(F.sequence(F.lit(1), F.lit(repeats))).alias("repeat")).withColumn("agent_id", ids.agent_id("persona_id", "model_id"))
    s = s.withColumn("test", F.lit(test)).withColumn("session_id", ids.session_id("test", "agent_id", "repeat"))
    return s.withColumn("order_seed", seeds.derived(study_seed, "order", "session_id"))


def kept_agents(sessions: DataFrame, agents: DataFrame) -> DataFrame:
    """The sessions of the listed agents, their ids and seeds as in the whole plan."""
    return sessions.join(agents.select("agent_id"), "agent_id", "left_semi")


def plan_trials(planned: DataFrame, shapes: DataFrame, variants: DataFrame, shuffle: bool = True) -> DataFrame:
    """Every trial of the sessions. variants: instrument, variants (names in order); a repeat
    uses the next one. The permutation of a session follows from its seed alone, so plans
    are the same however sessions are spread over tasks. They are spread over all, since a
    session becomes many trials and sessions may come from a few row groups."""
    spread = int(planned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    listed = shapes.join(variants, "instrument").agg(F.array_sort(F.collect_list(F.struct("place", "instrument", "clip_ids", "pair_id", "position", "variants"))).alias("shapes"))
    rows = planned.repartition(spread, "session_id").crossJoin(F.broadcast(listed))
    order = seeds.shuffled("order_seed", F.size("shapes")) if shuffle else F.sequence(F.lit(0), F.size("shapes") - 1)
    rows = rows.select(*planned.columns, "shapes", F.posexplode(order).alias("at", "k")).withColumn("s", F.get("shapes", F.col("k"))).withColumn("trial_index", F.col("at") + 1)
    variant = F.get("s.variants", ((F.col("repeat") - 1) % F.size("s.variants")).cast("int"))
    return rows.select(
        ids.trial_id("session_id", "trial_index").alias("trial_id"), "test", "session_id", "trial_index", "s.instrument", "s.clip_ids", "s.pair_id", "s.position",
        variant.alias("prompt_variant"), "order_seed", "repeat", "agent_id", "persona_id", "model_id",
    )


def profiles(spark: SparkSession, fraction: str = "1") -> DataFrame:
    """profile (bit pattern, low = 0) and one pole per trait, kept where each generated sign
    equals the product of its generating signs."""
    n = len(TRAITS)
    sign = {t: F.lit(1) - 2 * (1 - F.expr(f"cast((profile >> {n - 1 - i}) & 1 as int)")) for i, t in enumerate(TRAITS)}
    df = spark.range(2**n).withColumnRenamed("id", "profile")
    for generated, generating in GENERATORS[fraction]:
        product = F.lit(1)
        for t in generating:
            product = product * sign[t]
        df = df.filter(sign[generated] == product)
    return df.select("profile", *[F.when(sign[t] == 1, "high").otherwise("low").alias(t) for t in TRAITS])


def aliases(spark: SparkSession, fraction: str) -> DataFrame:
    """chain and its effects: effects that a fraction can't tell apart. An effect is a set of
    traits, a bit mask; the fraction's words span a group under XOR and the chains are its
    cosets."""
    mask = {t: 1 << i for i, t in enumerate(TRAITS)}
    group = [0]
    for generated, generating in GENERATORS[fraction]:
        word = mask[generated] | sum(mask[t] for t in generating)
        group += [g ^ word for g in group]
    letters = "".join(t[0].upper() for t in TRAITS)
    name = F.concat_ws("", *[F.when(F.expr(f"(m & {1 << i}) > 0"), F.lit(c)) for i, c in enumerate(letters)])
    effects = spark.range(1, 2 ** len(TRAITS)).select(F.col("id").cast("int").alias("effect"))
    coset = F.array(*[F.col("effect").bitwiseXOR(F.lit(g)) for g in group])
    rows = effects.filter(~F.array_contains(coset, 0)).withColumn("chain", F.array_min(coset)).select("chain", F.col("effect").alias("m"))
    named = rows.select("chain", F.bit_count("m").alias("order"), name.alias("name"), F.expr(f"reverse(lpad(bin(m), {len(TRAITS)}, '0'))").alias("bits"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("order", F.translate("bits", "01", "10").alias("bits"), "name"))), lambda x: x["name"])
    return named.groupBy("chain").agg(F.array_join(listed, "=").alias("alias"), F.count("*").alias("effects")).select("chain", "alias", "effects")


def in_fraction(personas: DataFrame, fraction: str) -> DataFrame:
    """The personas (a column per trait) whose profile belongs to a fraction: each generated
    pole is the product of its generating ones, high being 1 and low -1."""
    sign = lambda t: F.when(F.col(t) == "high", 1).otherwise(-1)
    for generated, generating in GENERATORS[fraction]:
        product = F.lit(1)
        for t in generating:
            product = product * sign(t)
        personas = personas.filter(sign(generated) == product)
    return personas


def alias_contrasts(personas: DataFrame, fraction: str) -> DataFrame:
    """alias, effects and contrast of each chain: personas of the fraction for which the product
    of an effect's poles is high, less those for which it is low. It is the same for all
    effects of a chain, so the chain's first one is worked out."""
    low = sum((F.when(F.col(t) == "low", 1 << i).otherwise(0) for i, t in enumerate(TRAITS)), F.lit(0))
    per = in_fraction(personas, fraction).groupBy(low.alias("low")).agg(F.count("*").alias("n"))
    chains = aliases(personas.sparkSession, fraction)
    both = chains.crossJoin(F.broadcast(per))  # at most 31 chains and 32 profiles
    sign = 1 - 2 * (F.bit_count(F.col("chain").bitwiseAND(F.col("low"))) % 2)
    return both.groupBy("alias", "effects").agg(F.sum(sign * F.col("n")).alias("contrast"))


def input_tokens(seconds: Column, chars: Column, media_rate: Column, chars_per_token: Column) -> Column:
    exact = lambda c: c.cast("decimal(18,6)")
    return (F.ceil(exact(seconds) * exact(media_rate)) + F.ceil(exact(chars) / exact(chars_per_token))).cast("bigint")


def usage_cost(tokens_in: Column, tokens_out: Column, price_in: Column, price_out: Column) -> Column:
    """USD of tokens at prices per million; null where a count is null or negative."""
    d = lambda c: c.cast("decimal(18,6)")
    cost = (d(tokens_in) * d(price_in) + d(tokens_out) * d(price_out)).cast("decimal(32,12)") / F.lit(1000000)
    return F.when((tokens_in >= 0) & (tokens_out >= 0), cost.cast(MONEY))


def trial_estimates(trials: DataFrame, clips: DataFrame, prices: DataFrame) -> DataFrame:
    """trials (trial_id, model_id, clip_ids, chars) with seconds, tokens_in and estimate.
    prices: model_id, provider, input_usd, output_usd, media_rate, chars_per_token,
    max_output_tokens."""
    shown = trials.select("trial_id", F.explode("clip_ids").alias("clip_id")).join(clips.select("clip_id", "duration_s"), "clip_id")
    seconds = shown.groupBy("trial_id").agg(F.sum(F.col("duration_s").cast("decimal(18,6)")).alias("seconds"))
    rows = trials.join(seconds, "trial_id", "left").join(F.broadcast(prices), "model_id").withColumn("seconds", F.coalesce("seconds", F.lit(0)))
    rows = rows.withColumn("tokens_in", input_tokens(F.col("seconds"), F.col("chars"), F.col("media_rate"), F.col("chars_per_token")))
    return rows.withColumn("estimate", usage_cost(F.col("tokens_in"), F.col("max_output_tokens"), F.col("input_usd"), F.col("output_usd")))


def cost_estimate(trials: DataFrame, clips: DataFrame, prices: DataFrame, max_retries: int = 2, transient_retries: int = 3) -> DataFrame:
    """Per test: expected cost of every trial once, worst case with every retry, trials, and
    the providers that get clips."""
    rows = trial_estimates(trials, clips, prices)
    out = rows.groupBy("test").agg(F.sum(F.col("estimate").cast("decimal(28,12)")).alias("expected"), F.count("*").alias("trials"), F.array_join(F.array_sort(F.collect_set(F.when(F.size("clip_ids") > 0, F.col("provider")))), ",").alias("providers"))
    return out.withColumn("worst_case", (F.col("expected") * (1 + max_retries + transient_retries)).cast(MONEY)).withColumn("expected", F.col("expected").cast(MONEY))


def media_worst_case(shapes: DataFrame, clips: DataFrame, limits: DataFrame) -> DataFrame:
    """Per model, instrument and limit: the largest total a trial can reach, its targets and
    whether it exceeds the limit.

    shapes: instrument, pairwise, practice (clip ids), targets (clip ids). limits: model_id,
    pos, max_seconds, max_bytes, base64. The worst trial shows the largest one or two targets;
    only those are kept per instrument, by a sort of the test's own clips."""
    size = lambda b: F.when(b, F.lit(4) * F.floor((F.col("size_bytes") + 2) / 3)).otherwise(F.col("size_bytes"))
    base = shapes.crossJoin(F.broadcast(limits))
    measured = clips.select("clip_id", "duration_s", "size_bytes")
    keep = ["model_id", "instrument", "pairwise", "max_seconds", "max_bytes", "base64"]

    def exploded(column: str) -> DataFrame:
        rows = base.select(*keep, F.explode(column).alias("clip_id")).join(measured, "clip_id")
        metrics = F.array(F.struct(F.lit("max_seconds").alias("limit"), F.col("max_seconds").cast("double").alias("allowed"), F.col("duration_s").alias("x")), F.struct(F.lit("max_bytes").alias("limit"), F.col("max_bytes").cast("double").alias("allowed"), size(F.col("base64")).cast("double").alias("x")))
        return rows.select("model_id", "instrument", "pairwise", "clip_id", F.explode(metrics).alias("m")).select("model_id", "instrument", "pairwise", "clip_id", "m.*")

    group = ["model_id", "instrument", "limit"]
    targets = exploded("targets").dropDuplicates([*group, "clip_id"])
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(F.desc("x"), "clip_id"))
    worst = targets.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("pairwise"), 2).otherwise(1))
    worst = worst.groupBy(*group).agg(F.sum("x").alias("shown"), F.max("allowed").alias("allowed"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "clip_id"))), lambda s: s["clip_id"]).alias("picked"))
    practice = exploded("practice").groupBy(*group).agg(F.sum("x").alias("practised"))
    total = F.round(F.col("shown") + F.coalesce("practised", F.lit(0.0)), 6)
    return worst.join(practice, group, "left").select(*group, "allowed", total.alias("total"), "picked", (total > F.col("allowed")).alias("exceeds"))
