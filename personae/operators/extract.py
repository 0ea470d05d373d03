"""Name candidates from the full-name, username and e-mail columns.

Every candidate is the same struct, so the scorer treats all sources alike:
promoted flags are columns, the remaining details are a JSON string in ``meta``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from personae.config import DEFAULT_DESCRIPTORS, DEFAULT_WEIGHTS, Descriptors, Weights
from personae.functions import text as T
from personae.operators.dictionary import NameDictionary

CANDIDATE_TYPE = (
    "struct<source:string,first_name:string,last_name:string,display_name:string,"
    "platform:string,profile_url:string,social_handle:string,email:string,"
    "confidence:int,ambiguous:boolean,business_like:boolean,handle_fallback:boolean,"
    "known_name:boolean,meta:string>"
)


def candidate(
    source: str | Column, *, confidence: int | Column, first_name: Column | None = None,
    last_name: Column | None = None, display_name: Column | None = None,
    platform: Column | None = None, profile_url: Column | None = None,
    social_handle: Column | None = None, email: Column | None = None,
    ambiguous: Column | None = None, business_like: Column | None = None,
    handle_fallback: Column | None = None, known_name: Column | None = None,
    meta: Column | None = None,
) -> Column:
    def text(c: Column | None) -> Column:
        return F.lit(None).cast("string") if c is None else c

    def flag(c: Column | None) -> Column:
        return F.lit(False) if c is None else F.coalesce(c, F.lit(False))

    return F.struct(
        (F.lit(source) if isinstance(source, str) else source).alias("source"),
        text(first_name).alias("first_name"),
        text(last_name).alias("last_name"),
        text(display_name).alias("display_name"),
        text(platform).alias("platform"),
        text(profile_url).alias("profile_url"),
        text(social_handle).alias("social_handle"),
        text(email).alias("email"),
        (F.lit(confidence) if isinstance(confidence, int) else confidence)
        .cast("int").alias("confidence"),
        flag(ambiguous).alias("ambiguous"),
        flag(business_like).alias("business_like"),
        flag(handle_fallback).alias("handle_fallback"),
        flag(known_name).alias("known_name"),
        text(meta).alias("meta"),
    )


def _no_candidate() -> Column:
    return F.lit(None).cast(CANDIDATE_TYPE)


def with_full_name_candidate(
    df: DataFrame, full_name: str = "n_full_name", out: str = "cand_full_name",
    weights: Weights = DEFAULT_WEIGHTS,
) -> DataFrame:
    """First and last word of the name; words in between are dropped."""
    ws = F.col("_words")
    built = candidate(
        "full_name",
        first_name=T.first_of(ws),
        last_name=T.last_of(ws),
        confidence=weights.full_name,
        meta=F.to_json(
            F.struct(
                F.size(ws).alias("tokenCount"),
                T.middle_of(ws).alias("droppedMiddleTokens"),
            )
        ),
    )
    return (
        df.withColumn("_words", T.words(F.col(full_name)))
        .withColumn(out, F.when(F.size(ws) > 0, built).otherwise(_no_candidate()))
        .drop("_words")
    )


def with_email_candidate(
    df: DataFrame, dictionary: NameDictionary, email: str = "n_email",
    out: str = "cand_email", row_id: str = "id", weights: Weights = DEFAULT_WEIGHTS,
) -> DataFrame:
    """Name order in the local part: the dictionary decides between two tokens."""
    parts, n = F.col("_parts"), F.size("_parts")
    address = T.js_trim(F.col(email))
    df = (
        df.withColumn("_parts", T.tokens(F.substring_index(address, "@", 1)))
        .withColumns({"_a": T.first_of(parts), "_b": T.last_of(parts)})
    )
    df = dictionary.flag(df, {"_a_known": "_a", "_b_known": "_b"}, row_id)
    a_known, b_known = F.col("_a_known"), F.col("_b_known")
    pair = n == 2
    swapped = pair & b_known & ~a_known
    ambiguous = ~(pair & (a_known != b_known))
    order = (
        F.when(swapped, "last_first")
        .when(pair & a_known & ~b_known, "first_last")
        .when(pair, "first_last_default")
    )
    built = candidate(
        "email",
        first_name=F.when(swapped, F.col("_b")).otherwise(F.col("_a")),
        last_name=F.when(swapped, F.col("_a")).otherwise(F.col("_b")),
        email=address,
        confidence=F.when(ambiguous, weights.email - weights.email_ambiguous_penalty)
        .otherwise(weights.email),
        ambiguous=ambiguous,
        known_name=a_known | b_known,
        meta=F.to_json(
            F.struct(
                F.when(~pair, n).alias("tokenCount"),
                order.alias("orderDetection"),
                ambiguous.alias("ambiguous"),
                T.middle_of(parts).alias("droppedMiddleTokens"),
            )
        ),
    )
    return df.withColumn(
        out, F.when(n > 0, built).otherwise(_no_candidate())
    ).drop("_parts", "_a", "_b", "_a_known", "_b_known")


def with_username_candidate(
    df: DataFrame, dictionary: NameDictionary, username: str = "n_username",
    out: str = "cand_username", row_id: str = "id", weights: Weights = DEFAULT_WEIGHTS,
    descriptors: Descriptors = DEFAULT_DESCRIPTORS,
) -> DataFrame:
    """A name out of a handle if the dictionary confirms one, else ``@handle``."""
    raw, kept, n = F.col("_raw"), F.col("_kept"), F.size("_kept")
    df = (
        df.withColumn("_handle", T.js_trim(F.col(username)))
        .withColumn("_raw", T.tokens(T.strip_descriptor_suffix(F.col("_handle"), descriptors)))
        .withColumn(
            "_kept",
            F.when(F.size(raw) > 1, F.filter(raw, lambda t: ~T.is_descriptor_word(t, descriptors)))
            .otherwise(raw),
        )
        .withColumns({"_a": T.first_of(kept), "_b": T.last_of(kept)})
    )
    df = dictionary.flag(df, {"_a_known": "_a", "_b_known": "_b"}, row_id)
    a_known, b_known = F.col("_a_known"), F.col("_b_known")
    single = n == 1
    df = df.withColumn("_run_on", F.when(single & ~a_known, F.col("_a")))
    df = dictionary.longest_prefix(df, "_run_on", "_cut", row_id)
    cut = F.col("_cut")
    df = df.withColumns(
        {
            "_first": F.when(single & a_known, F.col("_a"))
            .when(single, F.left("_a", cut))
            .when(a_known, F.col("_a"))
            .when(b_known, F.col("_b")),
            "_last": F.when(single, F.substring("_a", cut + 1, F.length("_a")))
            .when(a_known, F.col("_b"))
            .when(b_known, F.col("_a")),
        }
    )
    df = T.with_clean_names(
        df, {"_first_clean": "_first", "_last_clean": "_last"}, descriptors
    )
    df = dictionary.flag(
        df, {"_first_known": "_first_clean", "_last_known": "_last_clean"}, row_id
    )
    fallback = F.col("_first").isNull()
    built = candidate(
        "username",
        first_name=F.when(fallback, F.concat(F.lit("@"), "_handle"))
        .otherwise(F.col("_first_clean")),
        last_name=F.col("_last_clean"),
        confidence=weights.username,
        handle_fallback=fallback,
        known_name=F.col("_first_known") | F.col("_last_known"),
        meta=F.to_json(
            F.struct(
                n.alias("tokenCount"),
                F.when(single & ~a_known, cut.isNotNull()).alias("splitFromConcatenated"),
                F.when(fallback, True).alias("isHandleFallback"),
            )
        ),
    )
    usable = (n > 0) & (fallback | F.col("_first_clean").isNotNull())
    return df.withColumn(out, F.when(usable, built).otherwise(_no_candidate())).drop(
        "_handle", "_raw", "_kept", "_a", "_b", "_a_known", "_b_known", "_run_on", "_cut",
        "_first", "_last", "_first_clean", "_last_clean", "_first_known", "_last_known",
    )


def collect_candidates(*columns: str) -> Column:
    """Candidates in evidence order, absent ones dropped."""
    return F.array_compact(F.array(*columns))


def candidate_json(c: Column) -> Column:
    """The candidate as the JSON object kept in the audit log."""
    fields = F.to_json(
        F.struct(
            c["source"].alias("source"),
            c["first_name"].alias("firstName"),
            c["last_name"].alias("lastName"),
            c["display_name"].alias("displayName"),
            c["platform"].alias("platform"),
            c["profile_url"].alias("profileUrl"),
            c["social_handle"].alias("socialHandle"),
            c["email"].alias("email"),
            c["confidence"].alias("confidence"),
        )
    )
    with_meta = F.concat(
        F.regexp_replace(fields, r"\}$", ""), F.lit(',"meta":'), c["meta"], F.lit("}")
    )
    return F.when(c.isNull(), F.lit(None).cast("string")).otherwise(
        F.coalesce(with_meta, fields)
    )
