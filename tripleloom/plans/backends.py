"""Models behind small interfaces, with deterministic stand-ins that need no network."""

from __future__ import annotations

import hashlib
import json
import re
import time
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.names import Names

_ESCAPES = {i: f"\\u{i:04X}" for i in range(32)} | {ord(a): "\\" + b for a, b in zip('"\\\b\t\n\f\r', '"\\btnfr')}


def quoted(text: str | None) -> str:
    """A JSON string with the escapes of to_json."""
    return "null" if text is None else f'"{text.translate(_ESCAPES)}"'


class Ends(NamedTuple):
    """A relation to be matched to the names of its document. Its prompt lists all that share a word with it, so it is written only when it is asked."""

    subject: str | None
    relation: str | None
    object: str | None
    names: Names

    def prompt(self) -> str:
        s, r, o = (quoted(x) for x in self[:3])
        listed = ",".join(quoted(n) for n in self.names.listed(self.subject, self.object))
        return f'Match the ends of the relation to the entities.\n\n{{"subject":{s},"relation":{r},"object":{o},"entities":[{listed}]}}'


class Backend(Protocol):
    """Answers prompts; one object is built in each Python worker.

    One that has `match_ends` too is given relations and the names of their documents instead of their prompts.
    """

    def complete(self, prompts: list[str]) -> list[str]: ...


class Embedder(Protocol):
    def embed(self, texts: list[str]) -> np.ndarray: ...


class RuleBackend:
    """Entities are runs of capitalised words; triples are neighbouring entities of a sentence with the words between them."""

    NAME = re.compile(r"[^\W\d_a-z][^\W\d_]{2,}(?: [^\W\d_a-z][^\W\d_]{2,})*")

    def complete(self, prompts: list[str]) -> list[str]:
        return [self._one(p) for p in prompts]

    def match_ends(self, asked: list[Ends]) -> list[str]:
        """What the prompts would be answered, without writing and reading their lists."""
        return [_matched(x.names.nearest(x.subject, x.object), x.relation, x.names.nearest(x.object, x.subject)) for x in asked]

    def _one(self, prompt: str) -> str:
        task, _, body = prompt.partition("\n\n")
        if task.startswith("List the entities"):
            return json.dumps({"entities": self.NAME.findall(body)}, ensure_ascii=False)
        if task.startswith("List the triples"):
            out = []
            for s in re.split(r"(?<=[.!?])\s+", body):
                hits = list(self.NAME.finditer(s))
                for a, b in zip(hits, hits[1:]):
                    between = " ".join(s[a.end() : b.start()].split()).strip(" ,;:()\"'")
                    if between and len(between.split()) <= 8:
                        out.append({"subject": a.group(), "relation": between, "object": b.group()})
            return json.dumps({"triples": out}, ensure_ascii=False)
        if task.startswith("Split the triple"):
            t = json.loads(body)
            source, relation, out = t.get("subject") or "", t.get("relation") or "", []
            for e in t["entities"]:
                link = " ".join(e["before"].split()).strip(" ,;:.()\"'")
                if not out:
                    relation = f"{relation} {link}".strip()
                elif link not in ("", "and", "or", "as well as", "&"):
                    # words of their own between two entities make a chain, anything else a list
                    source, relation = out[-1]["object"], re.sub(r"^(?:and|or) ", "", link)
                out.append({"subject": source, "relation": relation, "object": e["term"]})
            out[-1]["relation"] = f"{relation} {t['entities'][-1]['after'].strip(' ,;:.')}".strip()
            return json.dumps({"triples": out}, ensure_ascii=False)
        if task.startswith("Repair the JSON"):
            return closed_json(body)
        if task.startswith("Summarise"):
            return body[:500]
        if task.startswith("Write atomic facts"):
            facts = [" ".join(x.split()) for x in re.split(r"(?<=[.!?])\s+", body) if x.strip()]
            return json.dumps({"facts": [{"fact": f, "supporting_span": f} for f in facts]}, ensure_ascii=False)
        try:
            t, _ = json.JSONDecoder().raw_decode(body)
        except ValueError:
            return "{}"
        rule = next((f for start, f in _RULES.items() if task.startswith(start)), None)
        return rule(t) if rule else "{}"


def closed_json(text: str) -> str:
    """JSON cut inside, closed where it stops: an open string ends, a dangling key or comma goes, brackets close."""
    stack, inside, at = [], False, 0
    while at < len(text):
        ch = text[at]
        if inside:
            at += ch == "\\"
            inside = ch != '"'
        elif ch == '"':
            inside = True
        elif ch in "{[":
            stack.append("}" if ch == "{" else "]")
        elif ch in "}]" and stack:
            stack.pop()
        at += 1
    out = re.sub(r'(?:,|,?\s*"[^"]*"\s*:)\s*$', "", text + '"' * inside)
    if stack and stack[-1] == "}":
        out = re.sub(r'([{,])\s*"[^"]*"\s*$', lambda m: "{" if m[1] == "{" else "", out)
    return out + "".join(reversed(stack))


def _has(text: str, part: str) -> bool:
    plain = lambda x: " ".join((x or "").lower().split())
    return plain(part).rstrip(".") in plain(text) and plain(part) != ""


def _without_ends(t: dict) -> str:
    relation = t["relation"].lower()
    for end in (t["subject"], t["object"]):
        relation = relation.replace(end.lower(), " ") if end else relation
    return json.dumps({"relation": " ".join(relation.split())}, ensure_ascii=False)


def _matched(subject: str | None, relation: str | None, object: str | None) -> str:
    return json.dumps({"subject": subject, "relation": relation, "object": object}, ensure_ascii=False)


def _nearest(end: str | None, names: list[str]) -> str | None:
    if end is None:
        return None
    words = lambda x: set(x.lower().split())
    return max(names, key=lambda n: (len(words(n) & words(end)), -len(words(n) | words(end)), n), default=end)


def _graph(t: dict) -> str:
    found = [{"relation": "appears with", "target_name": n} for n in dict.fromkeys(RuleBackend.NAME.findall(t["text"])) if n.lower() != t["entity"].lower()]
    return json.dumps({"central_entity": {"name": t["entity"], "relationships": found}}, ensure_ascii=False)


def _related(t: dict) -> str:
    parts = re.split(r"(?<=[.!?])\s+", t["evidence"].lower())
    pairs = [(a, b) for i, a in enumerate(t["entities"]) for b in t["entities"][i + 1 :] if any(a in p and b in p for p in parts)]
    return json.dumps({"triples": [{"subject": a, "relation": "mentioned with", "object": b} for a, b in pairs[:10]]}, ensure_ascii=False)


# what the stand-in answers, by the start of the task
_RULES = {
    "State the triple": lambda t: f"{t['subject']} {t['relation']} {t['object']}.",
    "Judge whether": lambda t: json.dumps({"verdict": "SUPPORTED" if _has(t["context"], t["statement"]) else "NOT_SUPPORTED"}),
    "Answer 1 if": lambda t: str(int(_has(t["context"], t["fact"]))),
    "Verify the fact": lambda t: json.dumps({"verdict": "SUPPORTED" if _has(t["text"], t["fact"]) else "NOT_STATED"}),
    "Classify the fact": lambda t: json.dumps({"category": ("AMBIGUOUS", "SINGLE_ENTITY", "MULTI_ENTITY")[min(2, len(set(RuleBackend.NAME.findall(t["fact"] or ""))))]}),
    "Fix the triple": _without_ends,
    "Rewrite so that": lambda t: " ".join(f"{t['subject']} {t['relation']} {t['object'].lower().replace(t['entity'], ' ', 1)} {t['entity']}.".split()),
    "Match the ends": lambda t: _matched(_nearest(t["subject"], t["entities"]), t["relation"], _nearest(t["object"], t["entities"])),
    "Do both name": lambda t: str(int(re.sub(r"\W", "", (t["a"] or "").lower()) == re.sub(r"\W", "", (t["b"] or "").lower()) != "")),
    "Draw the graph": _graph,
    "Relate the entities": _related,
}


class ReplayBackend:
    """Answers from a table of stored ones, keyed by the SHA-256 of the prompt; unknown prompts are empty."""

    def __init__(self, answers: dict[str, str]) -> None:
        self.answers = answers

    def complete(self, prompts: list[str]) -> list[str]:
        return [self.answers.get(hashlib.sha256(p.encode()).hexdigest(), "") for p in prompts]


class HashedEmbedder:
    """Unit vectors of hashed letter triples."""

    def __init__(self, dims: int = 64) -> None:
        self.dims = dims

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dims))
        for i, t in enumerate(texts):
            t = f" {t.lower()} "
            for k in range(len(t) - 2):
                h = zlib.crc32(t[k : k + 3].encode("utf-8", "surrogatepass"))
                out[i, h % self.dims] += 1 if h & 0x10000 else -1
        return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def with_retries(call, prompts: list[str], tries: int = 3, wait: float = 1.0) -> list[str | None]:
    """The answers, retried with doubling waits; a call that keeps failing answers null."""
    for k in range(tries):
        try:
            return call(prompts)
        except Exception:
            if k + 1 < tries:
                time.sleep(wait * 2**k)
    return [None] * len(prompts)


def complete(df: DataFrame, prompt: str, answer: str, backend, batch: int = 64) -> DataFrame:
    """Adds the answers to the prompts; equal prompts are asked once and joined back."""
    asked = df.select(F.col(prompt).alias("p")).where("p is not null").distinct()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        for b in batches:
            for k in range(0, len(b), batch):
                part = b["p"].iloc[k : k + batch].tolist()
                yield pd.DataFrame({"p": part, "a": with_retries(model.complete, part)})

    got = asked.mapInPandas(run, "p string, a string")
    return df.join(got.withColumnsRenamed({"p": prompt, "a": answer}), prompt, "left")


def ends_asked(rows: DataFrame, backend, suffix: str = "", batch: int = 64) -> DataFrame:
    """(doc_id, subject, relation, object, known, answer) of the relations among rows (doc_id, part, kind, subject, relation, object).

    The rows of a part of a document stand together in a partition, its names first (kind 0, in `subject`), then
    relations (kind 1). Those whose ends are both names are `known` and not asked.
    """

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = backend()
        match = getattr(model, "match_ends", None) if not suffix else None

        def answers(asked: list[Ends]) -> list[str]:
            return match(asked) if match else model.complete([x.prompt() + suffix for x in asked])

        at, listed, names = None, [], None
        for b in batches:
            rows, asked = [], []
            for doc, part, kind, *ends in zip(*(b[c].tolist() for c in ("doc_id", "part", "kind", "subject", "relation", "object"))):
                if at != (doc, part):
                    at, listed, names = (doc, part), [], None
                if kind == 0:
                    listed.append(ends[0])
                    continue
                if names is None:
                    names, listed = Names(listed), []
                rows.append((doc, *ends))
                asked.append(None if ends[0] in names.known and ends[2] in names.known else Ends(*ends, names))
            if not rows:
                continue
            todo = [x for x in asked if x is not None]
            got = iter([a for k in range(0, len(todo), batch) for a in with_retries(answers, todo[k : k + batch])])
            out = pd.DataFrame(rows, columns=["doc_id", "subject", "relation", "object"], dtype=object)
            yield out.assign(known=[x is None for x in asked], answer=pd.Series([None if x is None else next(got) for x in asked], dtype=object))

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInPandas(run, f"doc_id {kind}, subject string, relation string, object string, known boolean, answer string")


def embedded(df: DataFrame, text: str, out: str, embedder=HashedEmbedder) -> DataFrame:
    """Adds unit vectors; equal texts are encoded once and joined back."""
    asked = df.select(F.col(text).alias("p")).where("p is not null").distinct()

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = embedder()
        for b in batches:
            if b.empty:
                continue
            yield pd.DataFrame({"p": b["p"], "v": list(model.embed(b["p"].tolist()))})

    return df.join(asked.mapInPandas(run, "p string, v array<double>").withColumnsRenamed({"p": text, "v": out}), text, "left")
