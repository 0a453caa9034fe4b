"""The merge rule as a plain one-by-one walk, for comparing the Spark operator with."""

import hashlib
import json
import re


def _url_key(url):
    if not url:
        return None
    m = re.match(r"https?://([^/?#]+)([^?#]*)", url)
    return (m.group(1) + m.group(2).rstrip("/")).lower() if m else None


def _keys(w):
    out = {("doi", w["doi"]), ("ext", w["external_id"]), ("url", _url_key(w["url"]))}
    if w["title"] and w["publication_year"] is not None:
        author = w["authors"][0].lower() if w["authors"] else ""
        raw = f"{re.sub(r'[ ]+', ' ', w['title'].lower())}|{author}|{w['publication_year']}"
        out.add(("hash", hashlib.sha256(raw.encode()).hexdigest()))
    return {k for k in out if k[1] is not None}


def fold(works, preference=("openalex", "crossref")):
    place = {name: i for i, name in enumerate(preference)}
    walk = sorted(works, key=lambda w: (place.get(w["source"], len(preference)), w["seq"]))
    records = []
    for work in walk:
        keys = _keys(work)
        home = next((r for r in records if _keys(r) & keys), None)
        if home is None:
            records.append({**work, "metadata": dict(work["metadata"])})
            continue
        listed = home["metadata"].get("merged_sources", work["metadata"].get("merged_sources", "[]"))
        names = json.loads(listed)
        for source in (work["source"], home["source"]):
            if source not in names:
                names.append(source)
        home["metadata"] = {**work["metadata"], **home["metadata"], "merged_sources": json.dumps(names, separators=(",", ":"))}
        for field in ("title", "authors", "abstract", "doi", "url", "external_id"):
            home[field] = home[field] or work[field]
        if home["publication_year"] is None:
            home["publication_year"] = work["publication_year"]
    return records
