"""Schemas of landed data, as DDL."""

from __future__ import annotations

# One stored artifact document.
RECORD = (
    "type string, id long, name string, model_url string, download_url string, "
    "results string, net_score double"
)
# Ends a packed document; JSON holds this character only escaped.
RECORD_END = "\x1e"
# One stored object of a packed store.
OBJECT = "key string, content binary"
# One change of the registry: a record, or the key alone for deletions.
CHANGE = RECORD + ", seq long, op string"
# Hub reply for one model, one JSON document per line; cardData stays text,
# because its fields differ from card to card.
HUB_REPLY = (
    "model_id string, status_code int, sha string, downloads string, likes long, "
    "lastModified string, tags array<string>, cardData string, "
    "siblings array<struct<rfilename:string, content_length:string, content_range:string>>"
)
# Code-host replies: pull requests of a repository, and, per pull request, its
# reviews and files. A failed request has another status code.
PR_REPLY = (
    "repo string, status_code int, "
    "prs array<struct<number:long, updated_at:timestamp, merged_at:string>>"
)
REVIEW_REPLY = "repo string, number long, status_code int, reviews array<struct<id:long>>"
FILE_REPLY = (
    "repo string, number long, status_code int, "
    "files array<struct<filename:string, additions:long>>"
)
# Root listing of a code repository with the text of the files that were read.
CODE_LISTING = (
    "repo string, status_code int, entries array<struct<type:string, name:string, "
    "path:string, status_code:int, text:string>>"
)

INDEX_LINE = "name string, id string, type string, seq long"
README = "id long, path string, text string, type string"

# Tables of the registry that grow by runs (see ``sources.runs``), beside those of
# ``sources.readme_index``.
DECISION = (
    "type string, id long, name string, model_url string, status string, "
    "failures array<string>, results string, net_score double, error string"
)
REGISTRY = {
    "decisions": DECISION,
    "changes": RECORD + ", op string",
    "index": "name string, id string, type string",
}
# Landed replies about READMEs, by repository (``readmes.readme_key``).
README_REPLY = (
    "key string, status_code int, siblings array<struct<rfilename:string>>, "
    "readme_name string, content string, text string"
)
