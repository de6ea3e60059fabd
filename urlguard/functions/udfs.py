"""The two places where no native expression exists. Both run on Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

TAG_TYPE = T.ArrayType(
    T.StructType(
        [
            T.StructField("name", T.StringType()),
            T.StructField("attrs", T.MapType(T.StringType(), T.StringType())),
        ]
    )
)


def _idna(name: str | None) -> str | None:
    if name is None:
        return None
    try:
        return name.encode("idna").decode("ascii")
    except UnicodeError:
        return name


@F.pandas_udf(T.StringType())
def idna_host(hosts: pd.Series) -> pd.Series:
    """IDNA ASCII form of a host; unchanged where it cannot be encoded."""
    return hosts.map(_idna)


class _Tags(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []

    def handle_starttag(self, tag, attrs):
        first: dict[str, str] = {}
        for key, value in attrs:
            first.setdefault(key, value or "")
        self.found.append({"name": tag, "attrs": first})


def _tags(page: str | None) -> list[dict] | None:
    if page is None:
        return None
    parser = _Tags()
    parser.feed(page)
    parser.close()
    return parser.found


@F.pandas_udf(TAG_TYPE)
def html_tags(pages: pd.Series) -> pd.Series:
    """All start tags of a page by a strict parser: the exact, slower mode."""
    return pages.map(_tags)
