import random
import re

import pytest
from pyspark.sql import functions as F

from logweave.formats import BY_NAME, FORMATS
from logweave.operators.detection import candidate_formats, detect_format, parse_detected
from logweave.operators.parsing import coverage, parse_lines, rejected_lines, sample_lines, with_line_ids

SCHEMA = "log_id string, line_no bigint, line string"

# Two hand-written lines per format and the headers of the first one.
SAMPLES = {
    "HDFS": (
        ["081109 203615 148 INFO dfs.Node$Responder: Responder 1 for block blk_-38 stops",
         "081109 203807 222 WARN dfs.Node: Got error for blk_12 from 10.0.0.1:50010"],
        {"Date": "081109", "Time": "203615", "Pid": "148", "Level": "INFO", "Component": "dfs.Node$Responder",
         "Content": "Responder 1 for block blk_-38 stops"},
    ),
    "Hadoop": (
        ["2015-10-18 18:01:47,978 INFO [main] org.app.Master: Created master for job 7",
         "2015-10-18 18:01:48,963 WARN [IPC Server handler 3] org.ipc.Server: Slow call"],
        {"Process": "main", "Component": "org.app.Master", "Content": "Created master for job 7"},
    ),
    "Spark": (
        ["17/06/09 20:10:40 INFO executor.Backend: Registered handlers for [TERM, HUP]",
         "17/06/09 20:10:41 WARN storage.Manager: Block rdd_2 is gone"],
        {"Date": "17/06/09", "Level": "INFO", "Component": "executor.Backend",
         "Content": "Registered handlers for [TERM, HUP]"},
    ),
    "Zookeeper": (
        ["2015-07-29 17:41:44,747 - INFO  [Peer[id=1]/0:0:2181:Election@774] - Notification time out: 3200",
         "2015-07-29 19:04:12,394 - WARN  [Worker:Manager@368] - Connection broken"],
        {"Time": "17:41:44,747", "Level": "INFO", "Node": "Peer[id=1]/0", "Component": "0:2181:Election", "Id": "774"},
    ),
    "BGL": (
        ["- 1117838570 2005.06.03 R02-M1:J12 2005-06-03-15.42.50.675872 R02-M1:J12 RAS KERNEL INFO parity error corrected",
         "- 1117838573 2005.06.03 R02-M1:J12 2005-06-03-15.42.53.276129 R02-M1:J12 RAS KERNEL FATAL data TLB error"],
        {"Label": "-", "Timestamp": "1117838570", "Level": "INFO", "Content": "parity error corrected"},
    ),
    "HPC": (
        ["134681 node-246 unix.hw state_change.gone 1077804742 1 Component State Change: gone",
         "350766 node-109 unix.hw state_change.gone 1084680778 1 Component State Change: back"],
        {"LogId": "134681", "Flag": "1", "Content": "Component State Change: gone"},
    ),
    "Thunderbird": (
        ["- 1131566461 2005.11.09 dn228 Nov 9 12:01:01 dn228/dn228 crond(unix)[2915]: session closed for root",
         "- 1131566479 2005.11.09 dn228 Nov 9 12:01:19 dn228/dn228 ntpd: synchronized"],
        {"Component": "crond(unix)", "PID": "2915", "Content": "session closed for root"},
    ),
    "Windows": (
        ["2016-09-28 04:30:30, Info                  CBS    Loaded the stack v6.1",
         "2016-09-28 04:30:31, Error                 CSI    Failed 0x800f with code 3"],
        {"Time": "04:30:30", "Component": "CBS", "Content": "Loaded the stack v6.1"},
    ),
    "Linux": (
        ["Jun 14 15:16:01 combo sshd(unix)[19939]: authentication failure; uid=0",
         "Jun 14 15:16:02 combo kernel: out of memory"],
        {"Month": "Jun", "Level": "combo", "Component": "sshd(unix)", "PID": "19939",
         "Content": "authentication failure; uid=0"},
    ),
    "Android": (
        ["03-17 16:13:38.811  1702  2395 D WindowManager: freezing display", "03-17 16:13:38.820  1702  8671 V Audio: focus"],
        {"Pid": "1702", "Tid": "2395", "Level": "D", "Component": "WindowManager"},
    ),
    "HealthApp": (
        ["20171223-22:15:29:606|Step_LSC|30002312|onStep 3579", "20171223-22:15:29:615|Step_SPUtils|30002312|flush"],
        {"Component": "Step_LSC", "Content": "onStep 3579"},
    ),
    "Apache": (
        ["[Sun Dec 04 04:47:44 2005] [notice] env.init() ok", "[Sun Dec 04 04:47:45 2005] [error] child 6 in error state"],
        {"Time": "Sun Dec 04 04:47:44 2005", "Level": "notice", "Content": "env.init() ok"},
    ),
    "Proxifier": (
        ["[10.30 16:49:06] chrome.exe - proxy.example:5070 open through proxy",
         "[10.30 16:49:07] chrome.exe - proxy.example:5070 close, 0 bytes sent"],
        {"Program": "chrome.exe", "Content": "proxy.example:5070 open through proxy"},
    ),
    "OpenSSH": (
        ["Dec 10 06:55:46 LabSZ sshd[24200]: Invalid user from 1.2.3.4", "Dec 10 06:55:48 LabSZ sshd[24200]: closed"],
        {"Date": "Dec", "Day": "10", "Pid": "24200", "Component": "LabSZ"},
    ),
    "OpenStack": (
        ["api.log.1 2017-05-16 00:00:00.008 25746 INFO nova.wsgi.server [req-381 a b] 10.0.0.1 GET status: 200",
         "api.log.1 2017-05-16 00:00:00.272 25746 INFO nova.wsgi.server [req-9bc a b] 10.0.0.1 POST status: 202"],
        {"Logrecord": "api.log.1", "ADDR": "req-381 a b", "Content": "10.0.0.1 GET status: 200"},
    ),
    "Mac": (
        ["Jul  1 09:00:55 host-10 kernel[0] (thunder): wake", "Jul  1 09:01:05 host-10 calendar[27]: sync done"],
        {"User": "host-10", "Component": "kernel", "PID": "0", "Address": "thunder", "Content": "wake"},
    ),
}


def as_lines(spark, logs):
    rows = [(name, i + 1, line) for name, lines in logs.items() for i, line in enumerate(lines)]
    return spark.createDataFrame(rows, SCHEMA)


def test_every_format_has_samples():
    assert set(SAMPLES) == set(BY_NAME) and len(FORMATS) == 16


@pytest.mark.parametrize(
    ("name", "index"),
    [("Thunderbird", {"Component": 9, "PID": 11, "Content": 12}), ("Linux", {"PID": 7, "Content": 8}),
     ("Mac", {"PID": 6, "Address": 8, "Content": 9}), ("HDFS", {"Date": 1, "Content": 6})],
)
def test_group_numbers_count_unnamed_groups(name, index):
    assert {h: BY_NAME[name].group_index[h] for h in index} == index


def test_samples_parse(spark):
    for name, (lines, expected) in SAMPLES.items():
        parsed = parse_lines(as_lines(spark, {name: [" " + lines[0] + "\t", lines[1], "bad", ""]}), name)
        rows = parsed.orderBy("line_no").collect()
        assert [r.line_no for r in rows] == [1, 2], name
        assert {h: rows[0][h] for h in expected} == expected, name


def test_optional_header_is_null_when_absent(spark):
    rows = parse_lines(as_lines(spark, {"l": SAMPLES["Linux"][0]}), "Linux").orderBy("line_no").collect()
    assert [r.PID for r in rows] == ["19939", None]


def test_detection_and_parsing_of_mixed_logs(spark):
    lines = as_lines(spark, {name: sample[0] for name, sample in SAMPLES.items()})
    found = detect_format(lines)
    assert {r.log_id: r.format for r in found.collect()} == {name: name for name in SAMPLES}
    assert {r.coverage for r in found.collect()} == {1.0}
    parsed = parse_detected(lines, found).filter("line_no = 1").collect()
    assert len(parsed) == 16
    for row in parsed:
        expected = SAMPLES[row.log_id][1]
        assert {h: row.headers[h] for h in expected} == expected


def test_candidates_are_ranked(spark):
    lines = as_lines(spark, {"m": SAMPLES["Mac"][0] * 10})
    ranked = [r.format for r in candidate_formats(lines).orderBy("format_rank").collect()]
    assert ranked[0] == "Mac" and "Linux" in ranked


def test_fields_equal_backtracking_regex(spark):
    """The linear fast path and its guards against Python's plain regular expression."""
    draw = random.Random(5)
    pieces = ["a", "b:", ":", " ", "  ", "[", "]", "[7]", "(x)", "-", "|", ",", "@", "é", "\u0001", "12", ": "]
    texts = ["".join(draw.choices(pieces, k=draw.randint(0, 24))).strip() for _ in range(1500)]
    lines = as_lines(spark, {"r": texts})
    for fmt in FORMATS:
        pattern = re.compile(fmt.plain_regex)
        expected = {}
        for number, text in enumerate(texts):
            match = pattern.search(text)
            if match:
                expected[number + 1] = tuple(match.group(fmt.group_index[h]) for h in fmt.headers)
        parsed = parse_lines(lines, fmt).collect()
        got = {r.line_no: tuple(r[h] for h in fmt.headers) for r in parsed}
        assert got.keys() == expected.keys(), fmt.name
        for number, values in expected.items():
            # An optional part that is present but empty cannot be told from an absent one.
            wanted = tuple(
                (v or None) if h in fmt.optional_headers else v for h, v in zip(fmt.headers, values)
            )
            assert got[number] == wanted, (fmt.name, texts[number - 1])


def test_long_line_without_separator_is_rejected_quickly(spark):
    lines = as_lines(spark, {"l": ["word " * 20000]})
    assert rejected_lines(lines, "HDFS").count() == 1
    assert parse_lines(lines, "HDFS").count() == 0


def test_line_ids_coverage_and_sample(spark):
    good = SAMPLES["Spark"][0][0]
    logs = {"a": [good, "bad", good, good], "b": ["bad"] + [good] * 25}
    lines = as_lines(spark, logs)
    ids = with_line_ids(parse_lines(lines, "Spark"))
    got = {(r.log_id, r.line_no): r.LineId for r in ids.collect()}
    assert got == {("a", 1): 1, ("a", 3): 2, ("a", 4): 3, **{("b", i + 2): i + 1 for i in range(25)}}
    rates = {r.log_id: (r.n_lines, r.n_parsed, r.coverage) for r in coverage(lines, "Spark").collect()}
    assert rates == {"a": (4, 3, 0.75), "b": (26, 25, 25 / 26)}
    first = sorted((r.log_id, r.line_no) for r in sample_lines(lines, 10).collect())
    again = sorted((r.log_id, r.line_no) for r in sample_lines(lines.repartition(3), 10).collect())
    assert first == again and len(first) == 4 + 10
    other = sorted((r.log_id, r.line_no) for r in sample_lines(lines, 10, seed=1).collect())
    assert other != first
