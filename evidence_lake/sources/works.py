"""Bibliographic works: landed JSON payloads to one normalized table.

A payload row is one API answer (a page of works) as text, with ``payload_id``
giving its place in the list of answers; a work's ``seq`` is (answer, pos).  Everything here is row-wise, so the
functions take streaming DataFrames too.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evidence_lake import fixed_values as V
from evidence_lake.functions import maps
from evidence_lake.functions import text as T
from evidence_lake.operators.normalize import normalize_works

WORK_COLUMNS = (
    "seq", "source", "title", "authors", "abstract", "publication_year",
    "doi", "url", "external_id", "metadata",
)

_OPENALEX_ENVELOPE = "results array<string>"
_CROSSREF_ENVELOPE = "message struct<items: array<string>>"

# abstract_inverted_index keeps the raw object: the order of its keys decides collisions
_OPENALEX_WORK = """
    id string, doi string, title string, display_name string, publication_year string,
    type string, cited_by_count string,
    authorships array<struct<author: struct<display_name: string>>>,
    abstract_inverted_index map<string, array<int>>,
    primary_location struct<landing_page_url: string>
"""
_CROSSREF_WORK = """
    DOI string, title array<string>, type string, `is-referenced-by-count` string, abstract string,
    author array<struct<given: string, family: string, name: string>>,
    published struct<`date-parts`: array<array<int>>>,
    created struct<`date-parts`: array<array<int>>>,
    resource struct<primary: struct<URL: string>>,
    link array<struct<URL: string>>
"""


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Landed API answers, one JSON document per line, in order of file name and place in the file.

    ``payload_id`` is (file, start of the block, line): lines are counted within a task, so their order
    in a block, and with it the whole order, does not depend on how files are dealt out.
    """
    line = F.monotonically_increasing_id()
    return spark.read.text(path).select(
        F.struct(
            F.col("_metadata.file_path").alias("file"),
            F.col("_metadata.file_block_start").alias("block"),
            line.alias("line"),
        ).alias("payload_id"),
        F.col("value").alias("payload"),
    )


def number_works(works: DataFrame) -> DataFrame:
    """Stored works (``spark.read.parquet(...)``) with ``seq`` by file and row, for works that came
    without a list order."""
    place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row"))
    return works.select("*", place.alias("seq"))


def _items(source: str, refuse: bool = False) -> Column:
    """The list of works of an answer, NULL without one, or failing the query with ``refuse``."""
    _, envelope, items, _ = _SOURCES[source]
    found = items(F.from_json("payload", envelope))
    if not refuse:
        return found
    answer = F.to_json(F.struct("payload_id"))
    return F.coalesce(found, F.raise_error(F.concat(F.lit(f"answer of {source} without a list of works: "), answer)).cast("array<string>"))


def _explode_items(payloads: DataFrame, source: str, refuse: bool) -> DataFrame:
    """One row per work object; list members that are not objects are skipped.

    Answers and works are parsed in generators, which filters on what comes out of them are not pushed
    through: whatever is asked of the works, each is parsed once.
    """
    listed = payloads.select("payload_id", F.posexplode_outer(_items(source, refuse)).alias("pos", "item"))
    objects = listed.filter(F.json_object_keys("item").isNotNull())
    place = F.struct(F.col("payload_id").alias("answer"), "pos").alias("seq")
    return objects.select(place, F.explode(F.array(F.from_json("item", _SOURCES[source][3]))).alias("w"))


def malformed_payloads(payloads: DataFrame, source: str) -> DataFrame:
    """Answers without a list of works, which the sources below leave out."""
    return payloads.filter(_items(source).isNull())


def rebuild_abstract(index: Column) -> Column:
    """Text from word -> positions; the later word wins a position claimed twice.

    No words give an empty text, which normalization turns into NULL.
    """
    entries = F.map_entries(index)
    numbered = F.transform(entries, lambda e, i: F.struct(i.alias("n"), e["key"].alias("w"), e["value"].alias("at")))
    placed = F.flatten(
        F.transform(
            F.filter(numbered, lambda e: e["at"].isNotNull()),
            lambda e: F.transform(
                F.filter(e["at"], lambda p: p.isNotNull()),
                # descending entry number, so that the winner of a position comes first
                lambda p: F.struct(p.alias("p"), (-e["n"]).alias("n"), e["w"].alias("w")),
            ),
        )
    )

    def read_off(ordered: Column) -> Column:
        before = F.concat(F.array(F.lit(None).cast("struct<p:int,n:int,w:string>")), ordered)
        words = F.zip_with(
            ordered, before, lambda z, prev: F.when(prev.isNull() | (prev["p"] != z["p"]), z["w"])
        )
        return F.array_join(words, " ")

    # a one-element array names the sorted list, so that it is sorted once
    return F.get(F.transform(F.array(F.sort_array(placed)), read_off), F.lit(0))


def with_abstract(works: DataFrame) -> DataFrame:
    """Works that have an abstract; unlike a filter, this rebuilds each abstract once."""
    others = [c for c in works.columns if c != "abstract"]
    there = works.select(*others, F.explode(F.array_compact(F.array("abstract"))).alias("abstract"))
    return there.select(works.columns)


def openalex_works(payloads: DataFrame, refuse: bool = False) -> DataFrame:
    """Payload table -> normalized works; ``refuse`` fails on answers without a list of works."""
    w = F.col("w")
    landing = w["primary_location"]["landing_page_url"]
    names = F.transform(w["authorships"], lambda a: a["author"]["display_name"])
    works = _explode_items(payloads, "openalex", refuse)
    return normalize_works(
        works.select(
            "seq",
            F.lit("openalex").alias("source"),
            F.coalesce(T.blank_to_null(w["title"]), w["display_name"]).alias("title"),
            F.filter(names, lambda n: n.isNotNull() & (n != "")).alias("authors"),
            rebuild_abstract(w["abstract_inverted_index"]).alias("abstract"),
            w["publication_year"].alias("publication_year"),
            F.regexp_replace(w["doi"], f"^{V.DOI_URL_PREFIX.replace('.', '[.]')}", "").alias("doi"),
            F.coalesce(T.blank_to_null(w["doi"]), T.blank_to_null(landing), w["id"]).alias("url"),
            w["id"].alias("external_id"),
            maps.map_of_present(
                type=T.json_string(w["type"]), cited_by_count=w["cited_by_count"]
            ).alias("metadata"),
        )
    )


def _first_year(date: Column) -> Column:
    return F.nullif(F.get(F.get(date["date-parts"], F.lit(0)), F.lit(0)), F.lit(0))


def crossref_works(payloads: DataFrame, refuse: bool = False) -> DataFrame:
    """Payload table -> normalized works; abstract markup is kept as it is."""
    w = F.col("w")
    link_urls = F.filter(F.transform(w["link"], lambda x: x["URL"]), lambda u: u.isNotNull())

    def author_name(a: Column) -> Column:
        full = F.concat_ws(" ", T.blank_to_null(a["given"]), T.blank_to_null(a["family"]))
        return F.coalesce(T.blank_to_null(full), T.blank_to_null(a["name"]))

    works = _explode_items(payloads, "crossref", refuse)
    return normalize_works(
        works.select(
            "seq",
            F.lit("crossref").alias("source"),
            F.get(w["title"], F.lit(0)).alias("title"),
            F.filter(F.transform(w["author"], author_name), lambda n: n.isNotNull()).alias("authors"),
            w["abstract"].alias("abstract"),
            F.coalesce(_first_year(w["published"]), _first_year(w["created"])).alias("publication_year"),
            w["DOI"].alias("doi"),
            F.coalesce(
                w["resource"]["primary"]["URL"],
                F.get(link_urls, F.lit(0)),
                F.concat(F.lit(V.DOI_URL_PREFIX), w["DOI"]),
            ).alias("url"),
            w["DOI"].alias("external_id"),
            maps.map_of_present(
                type=T.json_string(w["type"]), is_referenced_by_count=w["is-referenced-by-count"]
            ).alias("metadata"),
        )
    )


# provider name -> (reader, envelope, path to the list of works, schema of one work)
_SOURCES = {
    "openalex": (openalex_works, _OPENALEX_ENVELOPE, lambda p: p["results"], _OPENALEX_WORK),
    "crossref": (crossref_works, _CROSSREF_ENVELOPE, lambda p: p["message"]["items"], _CROSSREF_WORK),
}
PROVIDERS: dict[str, Callable[[DataFrame], DataFrame]] = {name: s[0] for name, s in _SOURCES.items()}


class UnknownProvider(ValueError):
    """No reader is registered under this provider name."""


@dataclass
class LandedAnswers:
    """Answers set down by one job: those with a list of works, the others, and how many there are of each."""

    spark: SparkSession
    path: str
    accepted: int
    refused: int
    id_type: str

    def _of(self, route: str) -> DataFrame:
        rows = self.spark.read.schema(_LANDED).parquet(self.path)
        return rows.where(F.col("route") == route).drop("route").withColumn("payload_id", F.from_json("payload_id", self.id_type)["id"])

    def payloads(self) -> DataFrame:
        """Accepted answers (payload_id, payload), for :func:`search` or the source's reader."""
        return self._of("accepted")

    def malformed(self) -> DataFrame:
        """Refused answers (payload_id, payload) as they came."""
        return self._of("refused")


_LANDED = "payload_id string, payload string, route string"


def land_answers(payloads: DataFrame, source: str, path: str) -> LandedAnswers:
    """Set ``payloads`` down at ``path``, answers without a list of works apart from the others.

    One job reads the answers once, writes both kinds to folders of their own and counts them on the way.
    """
    if source not in _SOURCES:
        raise UnknownProvider(source)
    spark = payloads.sparkSession
    # a generator, so that the answer is parsed once for the folder and both counts
    verdict = F.explode(F.array(F.when(_items(source).isNull(), "refused").otherwise("accepted")))
    written = payloads.select(F.to_json(F.struct(F.col("payload_id").alias("id"))).alias("payload_id"), "payload", verdict.alias("route"))
    counts = Observation(f"answers-{uuid.uuid4().hex}")
    told = written.observe(counts, *[F.count_if(F.col("route") == r).alias(r) for r in ("accepted", "refused")])
    told.write.partitionBy("route").parquet(path)
    id_type = f"id {payloads.schema['payload_id'].dataType.simpleString()}"
    return LandedAnswers(spark, path, counts.get["accepted"], counts.get["refused"], id_type)


def search(
    payloads: DataFrame,
    provider: str = V.DEFAULT_PROVIDER,
    deduplicate: bool = True,
    providers: Mapping[str, Callable[[DataFrame], DataFrame]] | None = None,
    preference: tuple[str, ...] = V.PROVIDER_PREFERENCE,
    malformed: str = "fail",
) -> DataFrame:
    """Works of one provider's payloads, deduplicated unless told otherwise.

    Answers without a list of works fail the query; with ``malformed="skip"`` they are left out
    (``malformed_payloads`` lists them).
    """
    if malformed not in ("fail", "skip"):
        raise ValueError(f"malformed must be fail or skip, not {malformed!r}")
    readers = PROVIDERS if providers is None else providers
    if provider not in readers:
        raise UnknownProvider(provider)
    reader = readers[provider]
    refuse = {"refuse": malformed == "fail"} if reader is PROVIDERS.get(provider) else {}
    works = reader(payloads, **refuse)
    if not deduplicate:
        return works
    from evidence_lake.operators.dedup import deduplicate as fold

    return fold(works, preference)


def union_works(*works: DataFrame) -> DataFrame:
    """Works of several lists as one list, each list behind the one before it.

    ``seq`` becomes (list, place) with the list's own ``seq`` as place; the places of all lists must be
    of one type.
    """
    placed = [w.withColumn("seq", F.struct(F.lit(i).alias("list"), F.col("seq").alias("place"))) for i, w in enumerate(works)]
    return reduce(DataFrame.unionByName, placed)
