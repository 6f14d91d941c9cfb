import io
import json
import zipfile

from pyspark.sql import functions as F

from leafmill.operators import tree
from leafmill.sinks import packages as sink
from leafmill.sources import packages as source

XML = """<?xml version="1.0"?><environment xmlns="https://admin-shell.io/aas/3/0">
<assetAdministrationShells><assetAdministrationShell><id>urn:aas</id><idShort>A</idShort></assetAdministrationShell></assetAdministrationShells>
<submodels><submodel><id>urn:s</id><idShort>S</idShort><administration><version>1</version><revision>2</revision></administration>
<semanticId><type>ExternalReference</type><keys><key><type>GlobalReference</type><value>urn:sem</value></key></keys></semanticId><submodelElements>
<property><idShort>P</idShort><displayName><langStringNameType><language>en</language><text>Shown</text></langStringNameType></displayName>
<qualifiers><qualifier><type>Cardinality</type><valueType>xs:string</valueType><value>One</value></qualifier></qualifiers><valueType>xs:int</valueType><value>7</value></property>
<multiLanguageProperty><idShort>M</idShort><value><langStringTextType><language>de</language><text>Wort</text></langStringTextType></value></multiLanguageProperty>
<submodelElementCollection><idShort>C</idShort><value><property><idShort>Only</idShort><value>1</value></property></value></submodelElementCollection>
<submodelElementList><idShort>L</idShort><typeValueListElement>Property</typeValueListElement><value/></submodelElementList>
<referenceElement><idShort>R</idShort><value><type>ModelReference</type><keys><key><type>Submodel</type><value>urn:x</value></key></keys></value></referenceElement>
<blob><idShort>B</idShort><value>w6l0w6k=</value><contentType>text/plain</contentType></blob><blob><idShort>B2</idShort><value>/w==</value><contentType>image/x</contentType></blob>
<file><idShort>F</idShort><value>../files/a.txt</value><contentType>text/plain</contentType></file><file><idShort>G</idShort><value>/files/none.txt</value></file><file><idShort>H</idShort><value>https://x/y</value></file>
<entity><idShort>E</idShort><entityType>CoManagedEntity</entityType><statements><property><idShort>St</idShort><value>on</value></property></statements></entity>
<annotatedRelationshipElement><idShort>An</idShort><first><type>ExternalReference</type><keys><key><type>GlobalReference</type><value>urn:1</value></key></keys></first>
<second><type>ExternalReference</type><keys><key><type>GlobalReference</type><value>urn:2</value></key></keys></second><annotations><property><idShort>Why</idShort><value>so</value></property></annotations></annotatedRelationshipElement>
<operation><idShort>Op</idShort><inputVariables><operationVariable><value><property><idShort>In</idShort><value>i</value></property></value></operationVariable></inputVariables>
<inoutputVariables><operationVariable><value><submodelElementCollection><idShort>Io</idShort><value><property><idShort>Deep</idShort></property></value></submodelElementCollection></value></operationVariable></inoutputVariables></operation>
</submodelElements></submodel></submodels>
<conceptDescriptions><conceptDescription><id>urn:sem</id><idShort>Sem</idShort><embeddedDataSpecifications><embeddedDataSpecification><dataSpecificationContent><dataSpecificationIec61360>
<preferredName><langStringPreferredNameTypeIec61360><language>en</language><text>Name</text></langStringPreferredNameTypeIec61360></preferredName><unit>kg</unit></dataSpecificationIec61360></dataSpecificationContent></embeddedDataSpecification></embeddedDataSpecifications></conceptDescription></conceptDescriptions>
</environment>"""


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for k, v in files.items():
            z.writestr(k, v)
    return out.getvalue()


def read(spark, *contents):
    rows = [(f"p{i}", bytearray(c)) for i, c in enumerate(contents)]
    return source.parts(spark.createDataFrame(rows, "package string, content binary")).cache()


def test_xml_parts(spark):
    parts = read(spark, zipped({"aasx/data.xml": XML, "files/a.txt": "hello", "aasx/other.xml": XML.replace("aas/3/0", "aas/3/1")}), b"no zip", zipped({"a/b.json": b"\xff\xfe"}))
    objects = source.objects(parts).cache()
    assert sorted((r.package, r.kind) for r in objects.where("error is null and part = '/aasx/data.xml'").collect()) == [("p0", "concept"), ("p0", "shell"), ("p0", "submodel")]
    assert objects.where("part = '/aasx/other.xml' and kind = 'submodel'").count() == 1  # the newer release of the namespace
    assert [r.package for r in objects.where("error is not null").collect()] == ["p2"] and parts.where("error is not null").first().package == "p1"
    nodes = tree.flatten(objects.where("kind = 'submodel' and part = '/aasx/data.xml'").select(F.col("package").alias("template"), "doc"))
    got = {r.path: r for r in nodes.withColumn("value", tree.field("value")).collect()}
    assert [*sorted(got)] == sorted("P M C C.Only L R B B2 F G H E E.St An An.Why Op Op.In Op.Io Op.Io.Deep".split())
    assert (got["P"].value, got["B"].value, got["B2"].value, got["R"].value, got["Op.In"].value, got["An.Why"].value) == ("7", "été", "/w==", "urn:x", "i", "so")
    assert json.loads(got["M"].own)["value"] == {"de": "Wort"} and json.loads(got["P"].own)["qualifiers"][0]["value"] == "One" and got["Op.Io"].role == "inoutputVariables"
    files = {r.path: (r.part, r.missing, r.stored) for r in source.supplementary(nodes.withColumn("base", F.lit("/aasx/data.xml")), parts).collect()}
    assert files == {"F": ("/files/a.txt", False, "/files/a.txt"), "G": (None, True, "/files/none.txt"), "H": (None, False, "https://x/y")}


def test_packages_are_written_whole(spark):
    parts = read(spark, zipped({"aasx/data.xml": XML, "files/a.txt": "hello", "[Content_Types].xml": "<Types/>"}))
    objects = source.objects(parts).cache()
    again = source.parts(sink.packages(objects, parts)).cache()
    back = source.objects(again).cache()
    assert again.where("part = '/files/a.txt'").first().content == b"hello"
    doc = lambda x, kind: json.loads(x.where(f"kind = '{kind}'").first().doc)
    assert all(doc(objects, k) == doc(back, k) for k in ("submodel", "concept", "shell"))
    assert {r.kind: r.id for r in back.collect()} == {"submodel": "urn:s", "concept": "urn:sem", "shell": "urn:aas"}
    env = json.loads(again.where("part = '/aasx/data.json'").first().content)
    by = {e["idShort"]: e for e in env["submodels"][0]["submodelElements"]}
    assert by["B"]["value"] == "w6l0w6k=" and by["B2"]["value"] == "/w==" and by["P"]["displayName"][0]["text"] == "Shown" and env["submodels"][0]["administration"] == {"version": "1", "revision": "2"}


def test_long_parts_are_errors(spark):
    run = source.parts(spark.createDataFrame([("p", bytearray(zipped({"a.txt": "x" * 101, "b.txt": "y" * 100})))], "package string, content binary"), max_part=100)
    got = {r.part: (r.content, r.error) for r in run.collect()}
    assert got["/b.txt"] == (b"y" * 100, None) and got["/a.txt"] == (None, "ValueError: over 100 bytes")


def test_verify_reports(spark):
    docs = spark.createDataFrame([("a", '{"elements":[]}', "json"), ("b", "bad", "aasx"), ("c", "{}", "pdf"), ("d", None, "json")], "name string, doc string, format string")
    assert {r.name: r.error for r in sink.verify(docs).collect()} == {"a": None, "b": "document cannot be written", "c": "unknown format", "d": "document cannot be written"}


def test_deep_documents(spark):
    deep = "".join(f'{{"idShort":"a","modelType":"SubmodelElementCollection","elements":[' for _ in range(60)) + "]}" * 60
    docs = spark.createDataFrame([("deep", f'{{"elements":[{deep}]}}'), ("flat", '{"elements":[{"idShort":"x"}]}')], "template string, doc string")
    nodes = tree.flatten(docs)  # no level is cut
    assert nodes.where("template = 'flat'").count() == 1 and nodes.where("template = 'deep'").count() == 60 and tree.unreadable(nodes).count() == 0


def test_parts_of_many_packages_are_passed_on_together(spark):
    """A frame a package costs more than what is in it."""
    files = spark.createDataFrame([(f"p{i}", bytearray(zipped({"a.txt": str(i)}) if i % 2 else b"no zip")) for i in range(50)], "package string, content binary")
    sent = []

    class Seen:
        """Takes what a task would send."""

        def select(self, *names):
            return self

        def mapInArrow(self, run, schema):  # noqa: N802
            sent.extend(run(iter(files.toArrow().to_batches())))

    source.parts(Seen())
    assert [len(x) for x in sent] == [50] and sent[0].column(5).null_count == 25 and source.parts(files).count() == 50
