"""Sources that need a server or a file of their own: JDBC on an embedded database, whole and binary files, sockets."""

import socket
import threading
import uuid

import pytest


def test_jdbc_partitioned_read_and_write(spark, data):
    jars = spark.sparkContext._jvm.java.lang.Class
    try:
        jars.forName("org.apache.derby.jdbc.EmbeddedDriver")
    except Exception:
        pytest.skip("no embedded database")
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    customers = spark.read.parquet(f"{data}/customer.parquet").select("c_custkey", "c_acctbal")
    options = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    customers.coalesce(1).write.jdbc(url, "customer", properties=options)
    back = spark.read.jdbc(url, "customer", column="c_custkey", lowerBound=0, upperBound=1000, numPartitions=3, properties=options)
    assert back.rdd.getNumPartitions() == 3 and sorted(map(tuple, back.collect())) == sorted(map(tuple, customers.collect()))
    pushed = back.where("c_custkey < 10")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters" in pushed and "LessThan" in pushed.replace("< 10", "LessThan")


def test_whole_and_binary_files(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.txt").write_text(f"a{i}\nb")
    assert sorted(r.value for r in spark.read.text(str(tmp_path), wholetext=True).collect()) == ["a0\nb", "a1\nb", "a2\nb"]
    assert sorted(bytes(r.content) for r in spark.read.format("binaryFile").load(str(tmp_path)).collect()) == [b"a0\nb", b"a1\nb", b"a2\nb"]


def test_socket_stream(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        link, _ = server.accept()
        link.sendall(b"x\ny\nx\n")
        threading.Event().wait(8)
        link.close()

    threading.Thread(target=serve, daemon=True).start()
    lines = spark.readStream.format("socket").option("host", "127.0.0.1").option("port", server.getsockname()[1]).load()
    name = f"t{uuid.uuid4().hex}"
    query = lines.groupBy("value").count().writeStream.outputMode("complete").format("memory").queryName(name).start()
    for _ in range(20):
        query.processAllAvailable()
        found = {r.value: r["count"] for r in spark.table(name).collect()}
        if found:
            break
        threading.Event().wait(0.3)
    query.stop()
    assert found == {"x": 2, "y": 1}
