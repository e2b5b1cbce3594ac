"""The sixteen known line layouts and their compiled forms.

A layout is a line shape such as ``<Date> <Time> <Level>: <Content>``.  Compiling it
gives the header names and one anchored Java regular expression.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import cached_property

# (?U) makes \s \d \w \b Unicode-aware, (?d) leaves "\n" as the only line terminator.
JAVA_FLAGS = "(?Ud)"

WILDCARD = "<*>"
MAX_CHILDREN = 100


@dataclass(frozen=True)
class LogFormat:
    name: str
    layout: str
    masks: tuple[str, ...]
    st: float
    depth: int

    @cached_property
    def pieces(self) -> tuple[tuple[str, str], ...]:
        """``(header, literal after it)`` pairs; the first pair has an empty header."""
        parts = re.split(r"<(\w+)>", self.layout)
        literals = [re.sub(" +", r"\\s+", text) for text in parts[0::2]]
        return tuple(zip(["", *parts[1::2]], literals, strict=True))

    @cached_property
    def headers(self) -> tuple[str, ...]:
        return tuple(header for header, _ in self.pieces if header)

    @cached_property
    def optional_headers(self) -> frozenset[str]:
        """Headers inside a ``( ... )?`` part: absent means null, not an empty string."""
        depth, found = 0, set()
        for header, literal in self.pieces:
            if header and depth:
                found.add(header)
            bare = re.sub(r"\\.", "", literal)
            depth += bare.count("(") - bare.count(")")
        return frozenset(found)

    @cached_property
    def group_index(self) -> dict[str, int]:
        """Number of each header's capture group; unnamed optional groups count as well."""
        index, groups = {}, 0
        for header, literal in self.pieces:
            if header:
                groups += 1
                index[header] = groups
            groups += re.sub(r"\\.", "", literal).count("(")
        return index

    @cached_property
    def java_regex(self) -> str:
        """Anchored pattern with lazy headers; decides what each header holds."""
        return JAVA_FLAGS + "^" + self._assemble(lambda h: f"(?<{h}>.*?)", "", "(?<{}>.*)")

    @cached_property
    def fast_regex(self) -> str:
        """``java_regex`` without backtracking across separators: linear in the line.

        Where it matches, it makes only first choices, so ``java_regex`` gives the same
        headers.  It misses lines that match only by splitting one run of blanks.
        """
        return JAVA_FLAGS + "^" + self._assemble(lambda h: f"(?<{h}>.*?)", "(?>", "(?<{}>.*)")

    @cached_property
    def exists_regex(self) -> str:
        """Linear pattern that holds exactly for the lines ``java_regex`` matches.

        The header next to a run of blanks may take up the rest of the run, so one blank
        stands for ``\\s+`` at the edge of a separator; and every separator can be taken at
        its first place, because the header after it may take up any text.
        """
        return JAVA_FLAGS + "^" + self._assemble(
            lambda h: ".*?", "(?>", ".*", lambda text: re.sub(r"^\\s\+|\\s\+$", r"\\s", text)
        )

    @cached_property
    def plain_regex(self) -> str:
        """The same pattern with unnamed groups, for engines without named groups."""
        return "^" + self._assemble(lambda h: "(.*?)", "", "(.*?)")

    def _assemble(self, group, opener: str, last: str, literal=str) -> str:
        optional, out, nested = self.optional_headers, self.pieces[0][1], False
        *middle, (last_header, tail) = self.pieces[1:]
        followers = [header for header, _ in self.pieces[2:]]
        for (header, text), following in zip(middle, followers, strict=True):
            if header not in optional and opener:
                out, nested = out + opener, True
            out += group(header) + literal(text)
            if nested and following not in optional:
                out, nested = out + ")", False
        return out + last.format(last_header) + tail + "$"

    @cached_property
    def strict_regex(self) -> str:
        """Pattern for telling formats apart: each header must look like its kind of value."""
        out = self.pieces[0][1]
        for header, literal in self.pieces[1:]:
            bracketed = header == "Time" and literal.startswith(r"\]")
            value = r"[^\]]+" if bracketed else _SHAPES.get((self.name, header), _SHAPES.get(header, r"\S*?"))
            out += f"(?:{value})" + literal
        return "^" + re.sub(r"(?<!\\)\((?![?:])", "(?:", out) + "$"

    @cached_property
    def required_literal_length(self) -> int:
        """Characters every matching line must contain between its headers."""
        joined = "".join(literal for _, literal in self.pieces)
        joined = re.sub(r"\([^?]*?\)\?", "", joined)
        return len(re.sub(r"\\s\+", " ", joined).replace("\\", ""))


# Shapes of header values, used by format detection only.
_LEVELS = (
    r"(?i:trace|debug|info|information|notice|warn|warning|error|err|severe|fatal|critical|crit|"
    r"alert|emerg|failure|[VDIWEFA])"
)
_SHAPES: dict[str | tuple[str, str], str] = {
    "Date": r"\d[\d./-]*",
    "Day": r"\d{1,2}",
    "Month": r"[A-Z][a-z]{2}",
    "Time": r"\d[\d:.,-]*?",
    "Timestamp": r"\d+",
    "Level": _LEVELS,
    "Pid": r"\d+",
    "PID": r"\d+",
    "Tid": r"\d+",
    "Id": r"\d+",
    "LogId": r"\d+",
    "Flag": r"\d+",
    "Content": r".*",
    "Address": r"[^)]*",
    "Component": r"\S+?",
    "Program": r"\S.*?",
    ("Linux", "Level"): r"\S+",
    ("Linux", "Component"): r"[^\[\]]+?",
    ("OpenSSH", "Date"): r"[A-Z][a-z]{2}",
    ("OpenStack", "ADDR"): r"[^\]]*",
    ("BGL", "Level"): r"[A-Z]+",
    ("Mac", "Component"): r"[^\[\]]+?",
    ("Mac", "Address"): r"[^)]*",
    ("Zookeeper", "Component"): r"[^@]+?",
    ("Zookeeper", "Node"): r".*?",
    ("Hadoop", "Process"): r"[^\]]+",
    ("Thunderbird", "Component"): r"[^\[\]]+?",
}

# Layouts, masks, similarity thresholds and tree depths of the known formats.
FORMATS: tuple[LogFormat, ...] = (
    LogFormat(
        "HDFS",
        r"<Date> <Time> <Pid> <Level> <Component>: <Content>",
        (r"blk_-?\d+", r"(\d+\.){3}\d+(:\d+)?"),
        0.5,
        4,
    ),
    LogFormat(
        "Hadoop",
        r"<Date> <Time> <Level> \[<Process>\] <Component>: <Content>",
        (r"(\d+\.){3}\d+",),
        0.5,
        4,
    ),
    LogFormat(
        "Spark",
        r"<Date> <Time> <Level> <Component>: <Content>",
        (r"(\d+\.){3}\d+", r"\b[KGTM]?B\b", r"([\w-]+\.){2,}[\w-]+"),
        0.5,
        4,
    ),
    LogFormat(
        "Zookeeper",
        r"<Date> <Time> - <Level>  \[<Node>:<Component>@<Id>\] - <Content>",
        (r"(/|)(\d+\.){3}\d+(:\d+)?",),
        0.5,
        4,
    ),
    LogFormat(
        "BGL",
        r"<Label> <Timestamp> <Date> <Node> <Time> <NodeRepeat> <Type> <Component> <Level> <Content>",
        (r"core\.\d+",),
        0.5,
        4,
    ),
    LogFormat(
        "HPC",
        r"<LogId> <Node> <Component> <State> <Time> <Flag> <Content>",
        (r"=\d+",),
        0.5,
        4,
    ),
    LogFormat(
        "Thunderbird",
        r"<Label> <Timestamp> <Date> <User> <Month> <Day> <Time> <Location> <Component>(\[<PID>\])?: <Content>",
        (r"(\d+\.){3}\d+",),
        0.5,
        4,
    ),
    LogFormat(
        "Windows",
        r"<Date> <Time>, <Level>                  <Component>    <Content>",
        (r"0x.*?\s",),
        0.7,
        5,
    ),
    LogFormat(
        "Linux",
        r"<Month> <Date> <Time> <Level> <Component>(\[<PID>\])?: <Content>",
        (r"(\d+\.){3}\d+", r"\d{2}:\d{2}:\d{2}"),
        0.39,
        6,
    ),
    LogFormat(
        "Android",
        r"<Date> <Time>  <Pid>  <Tid> <Level> <Component>: <Content>",
        (
            r"(/[\w-]+)+",
            r"([\w-]+\.){2,}[\w-]+",
            r"\b(\-?\+?\d+)\b|\b0[Xx][a-fA-F\d]+\b|\b[a-fA-F\d]{4,}\b",
        ),
        0.2,
        6,
    ),
    LogFormat("HealthApp", r"<Time>\|<Component>\|<Pid>\|<Content>", (), 0.2, 4),
    LogFormat("Apache", r"\[<Time>\] \[<Level>\] <Content>", (r"(\d+\.){3}\d+",), 0.5, 4),
    LogFormat(
        "Proxifier",
        r"\[<Time>\] <Program> - <Content>",
        (r"<\d+\ssec", r"([\w-]+\.)+[\w-]+(:\d+)?", r"\d{2}:\d{2}(:\d{2})*", r"[KGTM]B"),
        0.6,
        3,
    ),
    LogFormat(
        "OpenSSH",
        r"<Date> <Day> <Time> <Component> sshd\[<Pid>\]: <Content>",
        (r"(\d+\.){3}\d+", r"([\w-]+\.){2,}[\w-]+"),
        0.6,
        5,
    ),
    LogFormat(
        "OpenStack",
        r"<Logrecord> <Date> <Time> <Pid> <Level> <Component> \[<ADDR>\] <Content>",
        (r"((\d+\.){3}\d+,?)+", r"/.+?\s", r"\d+"),
        0.5,
        5,
    ),
    LogFormat(
        "Mac",
        r"<Month>  <Date> <Time> <User> <Component>\[<PID>\]( \(<Address>\))?: <Content>",
        (r"([\w-]+\.){2,}[\w-]+",),
        0.7,
        6,
    ),
)

BY_NAME: dict[str, LogFormat] = {fmt.name: fmt for fmt in FORMATS}


def get_format(fmt: str | LogFormat) -> LogFormat:
    return fmt if isinstance(fmt, LogFormat) else BY_NAME[fmt]
