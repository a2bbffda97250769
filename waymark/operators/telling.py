"""Narration: a closed, numbered list of facts, one call of a model an owner, and what is wrong with its prose.

Facts come in a fixed order: measures, named places with what was seen near them, subjects. The story is kept as it was said; its defects
stand beside it. An owner without a fact is not asked and has an empty story. A list is short by definition: three measures, two
facts for each of a few places, a few subjects, so a group is bounded. A refusal leaves the story null, an unreachable model leaves out the owners
that it did not get to.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.operators.evidence import narration_defects
from waymark.operators.models import Unavailable
from waymark.sources.shipping import ship

# The languages that a story may be told in, and what a model is told to do.
LANGUAGES = {"ja": "Japanese", "en": "English"}
PROFILE_SYSTEM = (
    "You write a short profile of a person, addressed to them as 'you', from a closed list of numbered facts. Use only these facts. Do not invent details, do not generalise beyond what a"
    " fact states, and do not mention any coordinates. After each claim, cite the fact it rests on, like [F3]. Write two to four short paragraphs in {language}. Warm and concrete; no flattery."
)
INSIGHT_SYSTEM = (
    "You describe findings about the person's own photo history, from a closed list of numbered facts. Use only these facts, cite the fact behind each claim like [F2], never mention any"
    " coordinates, and add nothing the facts do not say. Answer in {language}, in one short paragraph."
)


def system(template: str, language: str) -> str:
    return template.format(language=LANGUAGES.get(language, "English"))


def facts_in_order(owners: DataFrame, parts: list[DataFrame]) -> DataFrame:
    """(owner_id, facts): the facts of ``parts`` (owner_id or none for facts of all owners, nth, fact), part by part; owners without one have an empty list.

    Facts under one number keep the order in which they sort.
    """
    rows = None
    for k, part in enumerate(parts):
        if "owner_id" not in part.columns:
            part = owners.select("owner_id").crossJoin(F.broadcast(part))  # a few facts
        one = part.select("owner_id", F.struct(F.lit(k).alias("part"), F.col("nth").cast("long").alias("nth"), "fact").alias("x"))
        rows = one if rows is None else rows.unionByName(one)
    lists = rows.groupBy("owner_id").agg(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["fact"]).alias("facts"))
    return owners.select("owner_id").distinct().join(lists, "owner_id", "left").select("owner_id", F.coalesce("facts", F.array().cast("array<string>")).alias("facts"))


def prompt(facts: Column) -> Column:
    """The numbered list that a model is given."""
    return F.array_join(F.transform(facts, lambda f, i: F.concat(F.lit("[F"), i + 1, F.lit("] "), f)), "\n")


def tell(listed: DataFrame, model: Callable[[str, list[str]], list[tuple[str | None, str | None]]], instruction: str) -> DataFrame:
    """(owner_id, story, refused, defects) of owners with their facts (owner_id, facts). ``model`` takes the instruction and prompts, gives (text, refusal)."""
    ship(listed.sparkSession)
    kind = listed.schema["owner_id"].dataType.simpleString()

    def run(frames):
        for f in frames:
            f = f.assign(story="", refused=None)
            ask = f.index[f["prompt"] != ""]
            try:
                got = model(instruction, f.loc[ask, "prompt"].tolist()) if len(ask) else []
            except Unavailable:
                yield f.drop(index=ask)[["owner_id", "facts", "story", "refused"]]
                return
            f.loc[ask, "story"] = [g[0] for g in got]
            f.loc[ask, "refused"] = [g[1] for g in got]
            yield f[["owner_id", "facts", "story", "refused"]]

    told = listed.select("owner_id", "facts", prompt(F.col("facts")).alias("prompt")).mapInPandas(run, f"owner_id {kind}, facts array<string>, story string, refused string")
    checked = narration_defects(told.withColumn("said", F.col("story")).withColumn("story", F.coalesce("story", F.lit(""))))
    return checked.select("owner_id", F.col("said").alias("story"), "refused", "defects")
