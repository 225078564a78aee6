"""The prose people wrote in a commit message, as sentences.

Layouts: a log entry (commit header, indented message), a mailed patch (From header, Subject, body up to ---), a changeset
export (# header) and a revision log (dashes, r<number> line). Headers, the subject line and the diff are left out, and of
the rest trailers, links, stack traces, hashes, commands, comments and the blocks of automatic updates.
"""

from __future__ import annotations

import re

_DIFF = re.compile(r"^(?:diff --git |diff -r |diff --cc |Index: |@@ -\d|--- \S+\t\(|GIT binary patch|Binary files )", re.M)
_TRAILER = re.compile(r"^(?:[A-Z][A-Za-z]*(?:-[A-Za-z]+)+|Fixes|Closes|Resolves|Refs|References|Bug|Issue|See|CC|Cc|Link|Change|Task|Ticket|Tested|Acked|Merge|Author|Date|Conflicts)\s?:\s*\S")
_AUTOMATIC = re.compile(r"^(?:\(cherry picked from|This reverts commit|git-svn-id:|Merge (?:branch|pull request|remote-tracking|tag)\b)", re.I)
_TRACE = re.compile(r"^\s*(?:at\s+[\w.$<>/]+\s*\(|File \"|Traceback \(|Caused by:|\.\.\. \d+ more|#\d+\s+0x|\w+(?:\.\w+)*(?:Error|Exception)\b)")
_COMMAND = re.compile(r"^\s*(?:\$|>|%|#|\||\+|\d+ files? changed|\w+@\w+[:#$])")
_LINK = re.compile(r"(?:https?|ftp|git|ssh)://\S+|www\.\S+|\S+@\S+\.\S+")
_HASH = re.compile(r"\b(?=[0-9a-f]*\d)[0-9a-f]{7,64}\b", re.I)
_CODE = re.compile(r"`[^`]*`|\S*[_/\\={}()\[\]<>;]\S*|\b[a-z]+[A-Z]\w*\b")
_ITEM = re.compile(r"^(\s*)(?:[-*+•]|\d{1,3}[.)])\s+")
_STOP = re.compile(r"(?<=[.!?])[\"')\]]*\s+")
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
#: Words a sentence of prose has at least, by default: fewer are headings, names and remnants of code.
LEAST_WORDS = 4


def message(text: str) -> list[str]:
    """Lines of the message without subject, header and diff."""
    found = _DIFF.search(text)
    lines = (text[: found.start()] if found else text).replace("\r\n", "\n").split("\n")
    first = lines[0] if lines else ""
    if first.startswith("commit "):
        at = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
        body = [x[4:] if x.startswith("    ") else x for x in lines[at:]]
    elif first.startswith("From "):
        at = next((i for i, x in enumerate(lines) if not x.strip()), len(lines))
        body = lines[at:]
        end = next((i for i, x in enumerate(body) if x.rstrip() == "---" and not "".join(body[i + 1 : i + 2]).startswith("updated-dependencies")), len(body))
        return body[:end]  # the subject is in the header
    elif first.startswith("# HG changeset"):
        at = next((i for i, x in enumerate(lines) if not x.startswith("#")), len(lines))
        body = lines[at:]
    elif first.startswith("-----"):
        at = next((i for i, x in enumerate(lines[1:], 1) if not x.strip()), len(lines))
        body = lines[at:]
    else:
        body = lines
    subject = next((i for i, x in enumerate(body) if x.strip()), len(body))
    return body[subject + 1 :]


def sentences(text: str | None, least_words: int = LEAST_WORDS) -> list[list[str]]:
    """The message's sentences as lists of lower-case words; NULL, empty and diff-only texts have none.

    Wrapped lines are joined; every list item is a sentence of its own, with or without a full stop. A sentence has at
    least *least_words* words.
    """
    if not text:
        return []
    blocks: list[list[str]] = []
    fresh, skipping = True, False
    for line in message(text):
        bare = line.strip()
        if skipping:
            skipping = bare not in ("...", "")
            continue
        if bare == "---" or bare.startswith("updated-dependencies:"):
            skipping, fresh = True, True
            continue
        if not bare or _TRAILER.match(bare) or _AUTOMATIC.match(bare) or _TRACE.match(line) or _COMMAND.match(line):
            fresh = True
            continue
        cleaned = _LINK.sub(" ", bare)
        hashed = _HASH.search(cleaned) is not None
        cleaned = _HASH.sub(" ", cleaned)
        if (hashed or cleaned != bare) and len(_WORD.findall(cleaned)) < least_words:
            fresh = True
            continue
        item = _ITEM.match(line)
        if item:
            blocks.append([_ITEM.sub("", cleaned)])
        elif fresh:
            blocks.append([cleaned])
        else:
            blocks[-1].append(cleaned)
        fresh = False
    found = []
    for block in blocks:
        for sentence in _STOP.split(" ".join(block)):
            words = [w.lower() for w in _WORD.findall(_CODE.sub(" ", sentence))]
            if len(words) >= least_words:
                found.append(words)
    return found
