"""Files through the Hadoop file system of the session, so that any store Spark reads works here too."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Files:
    def __init__(self, spark: SparkSession):
        self._gateway = spark.sparkContext._gateway
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def path(self, uri: str):
        return self._jvm.org.apache.hadoop.fs.Path(uri)

    def _fs(self, uri: str):
        return self.path(uri).getFileSystem(self._conf)

    def exists(self, uri: str) -> bool:
        return self._fs(uri).exists(self.path(uri))

    def names(self, uri: str) -> list[str]:
        return sorted(x.getPath().getName() for x in self._fs(uri).listStatus(self.path(uri))) if self.exists(uri) else []

    def size(self, uri: str) -> int:
        return self._fs(uri).getContentSummary(self.path(uri)).getLength()

    def delete(self, uri: str) -> None:
        self._fs(uri).delete(self.path(uri), True)

    def copy(self, source: str, target: str) -> None:
        self._jvm.org.apache.hadoop.fs.FileUtil.copy(
            self._fs(source), self.path(source), self._fs(target), self.path(target), False, True, self._conf
        )

    def read_json(self, uri: str) -> dict:
        stream = self._fs(uri).open(self.path(uri))
        try:
            return json.loads(self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def column_chunks(self, uri: str) -> Iterator[tuple[str, str, set[str]]]:
        """Column, codec and encodings of every column chunk of the Parquet files in a folder. Only footers are read, one at a time."""
        parquet = self._jvm.org.apache.parquet.hadoop
        for name in self.names(uri):
            if not name.endswith(".parquet"):
                continue
            reader = parquet.ParquetFileReader.open(parquet.util.HadoopInputFile.fromPath(self.path(f"{uri}/{name}"), self._conf))
            try:
                for group in reader.getFooter().getBlocks():
                    for chunk in group.getColumns():
                        codec = chunk.getCodec().name().removesuffix("_RAW")
                        yield chunk.getPath().toDotString(), codec, {e.name() for e in chunk.getEncodings()}
            finally:
                reader.close()

    def create_json(self, uri: str, value: dict) -> bool:
        """Write a new file whole; False when ``uri`` is already there. Every writer has a temporary file of its own,
        and the rename does not overwrite, so of two writers one is told that it lost."""
        fs = self._fs(uri)
        target = self.path(uri)
        fs.mkdirs(target.getParent())
        part = self.path(f"{uri}.{uuid.uuid4().hex}.part")
        stream = fs.create(part, False)
        try:
            stream.write(json.dumps(value).encode())
        finally:
            stream.close()
        hadoop = self._jvm.org.apache.hadoop.fs
        # No option: the rename fails where the target exists.
        options = self._gateway.new_array(hadoop.Options.Rename, 0)
        try:
            hadoop.FileContext.getFileContext(target.toUri(), self._conf).rename(fs.makeQualified(part), fs.makeQualified(target), options)
        except Py4JJavaError as error:
            fs.delete(part, False)
            if "AlreadyExists" in str(error.java_exception) or fs.exists(target):
                return False
            raise
        return True
