"""All registered queries: name -> (query, SQL or None)."""

from __future__ import annotations

from chaffline.plans import analysis, flagship, ranking, roundtrips, text, vectors

QUERIES = {
    **ranking.QUERIES,
    **text.QUERIES,
    **vectors.QUERIES,
    **analysis.QUERIES,
    **flagship.QUERIES,
    **roundtrips.QUERIES,
}
