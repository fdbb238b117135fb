import pytest
from pyspark.sql import functions as F

from logweir.functions import decoders
from logweir.functions.salvage import observables
from logweir.functions.templates import specificity, template
from logweir.operators import detect
from logweir.sources import lines, packs


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first()["r"]


@pytest.mark.parametrize(
    ("decode", "text", "expected"),
    [
        (decoders.rfc3164, "<34>Oct 11 22:14:15 mymachine su[123]: failed for x", {"pri": "34", "facility": "4", "severity": "2", "pid": "123", "message": "failed for x"}),
        (decoders.rfc3164, "<34>Oct 11 22:14:15 mymachine su: m", {"pid": None, "app": "su"}),
        (decoders.rfc5424, "<165>1 2003-10-11T22:14:15Z host app 12 ID47 - hello", {"hostname": "host", "app": "app", "severity": "5", "message": "hello", "sd": "-"}),
        (decoders.keyvalue, 'a=1 b="x y" a=2', {"a": "2", "b": "x y"}),
        (decoders.csv, 'a,"b ""q"", c",,d', {"col_0": "a", "col_1": 'b "q", c', "col_2": "", "col_3": "d"}),
        (decoders.cef, "<1>x CEF:0|V|P|1|7|Name|High|src=10.0.0.1 dpt=2", {"device_vendor": "V", "name": "Name", "extension": '{"src":"10.0.0.1","dpt":"2"}'}),
        (decoders.leef, "LEEF:1.0|V|P|1|7|src=10.0.0.1", {"vendor": "V", "event_id": "7", "extension": '{"src":"10.0.0.1"}'}),
        (decoders.json_object, 'head {"a": 1, "b": {"c": [1]}, "a": 2} tail', {"a": "2", "b": '{"c":[1]}'}),
        (decoders.xml, "<E><D n='1'>x</D><D>y</D><F k='v'/></E>", {"E": '{"D":["x","y"],"F":{"@k":"v"}}'}),
    ],
)
def test_decoded(spark, decode, text, expected):
    got = one(spark, decode, text)
    assert {k: got[k] for k in expected} == expected


@pytest.mark.parametrize(("decode", "text"), [(decoders.rfc3164, "x"), (decoders.rfc5424, ""), (decoders.keyvalue, "a=1"), (decoders.csv, "  "), (decoders.cef, "CEF:x"), (decoders.leef, None), (decoders.json_object, "{a"), (decoders.xml, "<a"), (decoders.xml, None)])
def test_undecoded(spark, decode, text):
    assert one(spark, decode, text) is None


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("<a>x</a>", '{"a": "x"}'),
        ("<a k='1'>x</a>", '{"a": "x"}'),
        ("<a k='1'/>", '{"a": {"@k": "1"}}'),
        ("<a/>", '{"a": {}}'),
        ("<n:a xmlns:n='u'>t<b>1</b><c/><b>2</b><b k='v'>3<d/></b>u</n:a>", '{"a": {"b": ["1", "2", {"d": {}, "#text": "3", "@k": "v"}], "c": {}, "#text": "t"}}'),
        ("<a>é &amp; <![CDATA[<b>]]></a>", '{"a": "é & <b>"}'),
        ("<a><b></a>", None),
        ("<a/><b/>", None),
        ("", None),
        (None, None),
    ],
)
def test_xml_is_shaped_by_tags(text, expected):
    assert decoders.xml_json(text) == expected


def test_cef_extension_of_one_pair_is_dropped(spark):
    assert "extension" not in one(spark, decoders.cef, "CEF:0|V|P|1|7|N|High|src=10.0.0.1")


def test_observables_and_templates(spark):
    got = one(spark, observables, "from 10.0.0.1 and 10.0.0.1 port 443 port=99999 mail a@b.org " + "a" * 64)
    assert (got["ip_addresses"], got["ports"], got["emails"], got["hashes_sha256"], got["urls"]) == (["10.0.0.1"], [443], ["a@b.org"], ["a" * 64], None)
    assert one(spark, template, " job 12 at 10.0.0.1 0xff ") == "job <*> at <*> <*>"
    assert one(spark, lambda t: specificity(template(t)), "job 12 at 10.0.0.1") == 0.5
    assert one(spark, specificity, "") == 0.0


FIXTURES = {
    "apache_access": '10.20.30.40 - carol [03/Feb/2025:08:09:10 +0100] "PUT /shop/cart?id=7 HTTP/1.0" 302 17',
    "apache_error": "[Mon Feb 03 08:09:10 2025] [warn] [client 10.20.30.41] script ran for 9 seconds",
    "aws_vpc_flow": "2 111122223333 eni-00aa11bb 10.1.2.3 10.4.5.6 1111 2222 17 3 180 1738570150 1738570210 REJECT OK",
    "cef": "CEF:0|Weirworks|Gate|3|41|port scan|Low|src=10.9.8.7 dst=10.6.5.4 act=alert",
    "cisco_asa": "%ASA-6-302014: Teardown inbound UDP connection 5 for dmz:10.2.2.2/53 to inside:10.3.3.3/5353",
    "fortinet_fortios": 'devname="edge 9" type=traffic srcip=10.7.7.7 action=close',
    "linux_sshd": "Feb  3 08:09:10 bastion sshd[31]: Failed publickey for deploy from 10.5.5.5 port 2200 ssh2",
    "nginx_access": '10.20.30.42 - [03/Feb/2025:08:09:11 +0100] "HEAD /status HTTP/1.1" 204 0 "-" "probe/0.1"',
    "paloalto_panos": "1,2025/02/03 08:09:10,000111,TRAFFIC,end,9,2025/02/03 08:09:09,10.8.8.8,10.9.9.9",
    "rfc5424_fallback": "<14>1 2025-02-03T08:09:10Z edge9 relay 77 M1 - queue is empty",
    "suricata_eve": '{"event_type":"dns","src_ip":"10.11.12.13","src_port":5353,"dns":{"rrname":"weir.example"}}',
    "windows_security": '<Event><System><Provider Name="Microsoft-Windows-Security-Auditing"/><EventID>4634</EventID></System></Event>',
    "salvage": "Feb  3 08:09:10 bastion sshd[32]: Failed password for invalid user y from 10.5.5.6 port 2201 ssh2",
}


def test_every_pack_claims_and_decodes_its_fixture(spark):
    df = lines.records(spark, FIXTURES.values())
    got = {r["line_no"]: r for r in detect.extract(detect.route(df)).collect()}
    for i, name in enumerate(FIXTURES, 1):
        assert got[i]["pack"] == name
        assert (got[i]["fields"] is None) == (name == "salvage")
    assert got[2]["fields"]["src_ip"] == "10.20.30.41"


def test_packs_from_a_folder(tmp_path, spark):
    (tmp_path / "b.yaml").write_text("vendor: V\ndetection: {prefixes: ['x:']}\ndecoders: [keyvalue]\n")
    (tmp_path / "a.yml").write_text("vendor: W\n")
    (tmp_path / "bad.yaml").write_text("a: [")
    got = packs.from_folder(str(tmp_path))
    assert [p.id for p in got] == ["b", "a"]
    rows = detect.extract(detect.route(lines.records(spark, ["x: a=1 b=2", "y: a=1 b=2"]), got), got).orderBy("line_no").collect()
    assert [r["pack"] for r in rows] == ["b", "salvage"]


def test_files_number_their_lines(tmp_path, spark):
    (tmp_path / "a.log").write_text("one\n\n  two \nthree\n")
    got = lines.files(spark, str(tmp_path / "a.log")).orderBy("line_no").collect()
    assert [(r["line_no"], r["raw_text"], bytes(r["raw_bytes"])) for r in got] == [(1, "one", b"one"), (3, "two", b"  two "), (4, "three", b"three")]
