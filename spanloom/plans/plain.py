"""Plain text translation: guard, budget, batched model, checks and retry of the rows that fail."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import budget
from ..functions import text as T
from ..operators.model import Guard, model_map
from ..sources.config import Translation


def translate(df: DataFrame, text_col: str, model: Callable | None = None, style: Column | None = None, most_chars: int = 4000, most_tokens: int = 1024, clean: bool = True, retry: bool = False, held: list[DataFrame] | None = None, translation: Translation | None = None, pair: tuple[Column, Column] | None = None, guard: Guard = Guard()) -> DataFrame:  # noqa: B008
    """df with translation and error. Rows that a guard stops never reach the model; nothing is cut.

    The model is told each row's budget, languages and style. A row whose output is degenerate, or a phrase whose
    output its policy has asked for again, is sent once more alone (retry), in the simpler way of the settings, then
    fails; rows that passed aren't sent again: the first pass is persisted, and given to ``held`` for a caller that
    lives on to release. What the model or its loader raises is its rows' error class.
    """
    translation = translation or Translation()
    generation = translation.generation
    style = F.lit("sentence") if style is None else style
    pair = pair or (F.lit(translation.source_language), F.lit(translation.target_language))
    done = T.preprocessed(F.col(text_col), most_chars)
    rows = df.withColumn("__p", done).withColumn("__text", F.col("__p.text") if clean else F.when(F.col("__p.error").isNull(), F.col(text_col)))
    rows = rows.withColumn("__n", budget.measure(F.col("__text")))
    over = F.col("__n") > most_tokens if clean else F.lit(False)
    rows = rows.withColumn("error", F.coalesce(F.col("__p.error"), F.when(over, "over_token_budget"))).withColumn("__text", F.when(F.col("error").isNull(), F.col("__text")))
    rows = rows.withColumn("__budget", budget.engine_budget(F.col("__n"), style, F.lit(None)))
    out = model_map(rows, "__text", "translation", model, translation.batch_size, F.col("__budget"), pair, style, guard, "__fault")
    if retry:
        phrase = budget.phrase_check(F.col("__text"), F.coalesce("translation", F.lit("")), generation.phrase_max_expansion)["reasons"]
        policy = F.when(style == "phrase", generation.phrase_scaffolding).otherwise("off")
        poor = lambda retried: F.when(budget.degenerate(F.coalesce("translation", F.lit("")), F.col("__n"), generation.max_repeated_token_run, generation.max_repeated_ngram_ratio), "degenerate_output").when(budget.phrase_action(phrase, policy, F.lit(retried)).isin("retry", "quality_error"), "phrase_rejected")
        answered = F.col("error").isNull() & F.col("__fault").isNull()
        out = out.withColumn("__poor", F.when(answered, poor(False))).persist()
        if held is not None:
            held.append(out)
        simpler = Guard(guard.seconds, guard.slow, generation.retry_num_beams)
        again = model_map(out.filter("__poor IS NOT NULL").drop("translation", "__fault"), "__text", "translation", model, 1, F.least("__budget", F.lit(generation.retry_max_new_tokens)), pair, style, simpler, "__fault")
        again = again.withColumn("error", F.when(F.col("__fault").isNull(), poor(True)))
        out = out.filter("__poor IS NULL").unionByName(again.select(out.columns)).drop("__poor")
    out = out.withColumn("error", F.coalesce("error", "__fault"))
    return out.withColumn("translation", F.when(F.col("error").isNull(), F.col("translation"))).drop("__p", "__text", "__n", "__budget", "__fault")
