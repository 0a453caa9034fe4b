"""Record-level normalization of works."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidence_lake.functions import maps
from evidence_lake.functions import text as T


def normalize_works(works: DataFrame) -> DataFrame:
    """Normalize every field; a rejected year, DOI or URL survives as ``metadata['raw_*']``.

    Applying it twice changes nothing: rejected fields are NULL afterwards, and raw
    values already recorded win over new ones.
    """
    year = T.normalize_year(F.col("publication_year"))
    doi = T.normalize_doi(F.col("doi"))
    url = T.normalize_url(F.col("url"))
    year_json = F.when(
        F.col("publication_year").cast("string").rlike("^-?[0-9]+$"), F.col("publication_year").cast("string")
    ).otherwise(T.json_string(F.col("publication_year").cast("string")))
    rejected = maps.map_of_present(
        raw_publication_year=F.when(year.isNull(), year_json),
        raw_doi=F.when(doi.isNull(), T.json_string(F.col("doi"))),
        raw_url=F.when(url.isNull(), T.json_string(F.col("url"))),
    )
    metadata = F.coalesce(F.col("metadata"), F.create_map().cast("map<string,string>"))
    return works.withColumns(
        {
            "title": T.normalize_text(F.col("title")),
            "authors": T.normalize_authors(F.col("authors")),
            "abstract": T.normalize_text(F.col("abstract")),
            "publication_year": year,
            "doi": doi,
            "url": url,
            "metadata": maps.merge_maps(metadata, rejected),
        }
    )
