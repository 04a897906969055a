"""Types of the domain's nested rows."""

from __future__ import annotations

COMMIT = "sha string, message string, author string, author_login string, timestamp string, files_touched array<string>, patches array<struct<filename:string,patch:string>>"
FILE = "filename string, status string, additions int, deletions int, changes int, patch string"
ISSUE = "number int, repo string, title string, body string, state string, url string, keyword_used string, source string"
NODE = "id string, label string, attrs map<string,string>"
EDGE = "src string, dst string, label string, attrs map<string,string>"
JUDGMENT = (
    "original_score double, generated_score double, prefers string, reason string,"
    " original_breakdown struct<correctness_penalty:double,coverage_penalty:double,clarity_penalty:double,penalties:array<string>>,"
    " generated_breakdown struct<correctness_penalty:double,coverage_penalty:double,clarity_penalty:double,penalties:array<string>>"
)
