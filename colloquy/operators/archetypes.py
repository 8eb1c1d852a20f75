"""Conversation-level features and their clustering into archetypes."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import StandardScaler
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colloquy.schema import FLAG_COLUMNS
from colloquy.session import written_table
from colloquy.settings import AnalyticsSettings

# Features of a conversation.
FEATURE_COLUMNS = (
    *FLAG_COLUMNS, "dependency_score", "companionship_score", "vulnerability_score",
    "prompt_sophistication_score", "conversational_depth_score",
)


def conversation_features(df: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """Mean of every feature, number of turns and mean length per conversation."""
    present = [c for c in FEATURE_COLUMNS if c in df.columns]
    aggregates = [F.avg(F.col(c).cast("double") if c not in FLAG_COLUMNS else F.col(c).cast("int")).alias(c)
                  for c in present]
    aggregates.append(F.count(F.lit(1)).alias("num_turns"))
    if "prompt_word_count" in df.columns:
        aggregates.append(F.avg("prompt_word_count").alias("mean_prompt_word_count"))
    return df.filter(F.col(conversation).isNotNull()).groupBy(conversation).agg(*aggregates)


def name_archetypes(summary: DataFrame) -> DataFrame:
    """Name each archetype after its strongest trait; the first listed trait wins ties."""
    def mean(name: str) -> Column:
        return F.coalesce(F.col(name), F.lit(0.0)) if name in summary.columns else F.lit(0.0)

    traits = (
        ("Emotional Support Seekers", mean("is_vulnerable") + mean("companionship_score")),
        ("Cognitive Outsourcers", mean("is_cognitive_outsourcing")),
        ("Dependency-Oriented Users", mean("dependency_score") + mean("is_dependency_signal")),
        ("Conversational Collaborators",
         mean("prompt_sophistication_score") + mean("conversational_depth_score")),
        ("Casual/Utility Users", F.lit(1.0) - mean("is_vulnerable")),
    )
    ranked = F.greatest(
        *[F.struct(score.cast("double").alias("score"), F.lit(-i).alias("order"), F.lit(name).alias("name"))
          for i, (name, score) in enumerate(traits)]
    )
    return summary.withColumn("archetype_name", ranked["name"])


def summarize_archetypes(assignments: DataFrame, conversation: str = "conversation_id") -> DataFrame:
    """Size, feature means and name per archetype."""
    features = [c for c in assignments.columns if c not in (conversation, "archetype")]
    means = [F.avg(c).alias(c) for c in features]
    summary = assignments.filter(F.col("archetype").isNotNull()).groupBy("archetype").agg(
        F.count(F.lit(1)).alias("num_conversations"), *means
    )
    return name_archetypes(summary)


def discover_archetypes(df: DataFrame, settings: AnalyticsSettings = AnalyticsSettings()) -> DataFrame:
    """Assign each conversation with enough turns to an archetype by KMeans on scaled features.

    Scaling and clustering read the features many times, so these are written out once. With fewer
    than two conversations every assignment is null.
    """
    conversation = settings.conversation_column
    features = written_table(
        conversation_features(df, conversation).filter(F.col("num_turns") >= settings.min_conversation_records),
        "conversation-features",
    )
    available = features.limit(max(settings.n_archetypes, 2)).count()
    if available < 2:
        return features.withColumn("archetype", F.lit(None).cast(T.IntegerType()))
    inputs = [c for c in features.columns if c != conversation]
    filled = features.select(
        conversation, *inputs, F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(0.0)) for c in inputs]).alias("_values")
    )
    vectors = filled.withColumn("_raw", array_to_vector("_values"))
    scaler = StandardScaler(inputCol="_raw", outputCol="_scaled", withMean=True, withStd=True).fit(vectors)
    scaled = scaler.transform(vectors)
    model = KMeans(
        k=min(settings.n_archetypes, available), seed=settings.seed, featuresCol="_scaled", predictionCol="archetype"
    ).fit(scaled)
    return model.transform(scaled).drop("_values", "_raw", "_scaled")
