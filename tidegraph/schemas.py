"""Schemas of the sources."""

RAW_PAGE = "title STRING, id BIGINT, redirect STRUCT<_title: STRING>, revision STRUCT<text: STRING>"
