import os
import sys
import zipfile

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path[:0] = [ROOT, os.path.join(ROOT, "tests")]

from shelfline.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, "shelfline-tests", partitions=2)
    yield session
    session.stop()


@pytest.fixture
def drop(tmp_path):
    """A drop folder with a helper that puts zipped text files into it."""

    class Drop:
        path = str(tmp_path / "drop")

        def put(self, name, text, inner="data.txt", before=(), at=None):
            target = tmp_path / "drop" / name
            target.parent.mkdir(parents=True, exist_ok=True)
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as archive:
                for other, content in before:
                    archive.writestr(other, content)
                archive.writestr(inner, text)
            if at is not None:
                os.utime(target, (at, at))
            return str(target)

        def put_raw(self, name, content: bytes):
            target = tmp_path / "drop" / name
            target.parent.mkdir(parents=True, exist_ok=True)
            target.write_bytes(content)

    return Drop()


@pytest.fixture
def table(spark):
    """``table(ddl, *rows)`` with ISO text for dates."""

    def build(ddl, *rows):
        from pyspark.sql import functions as F
        from pyspark.sql import types as T

        wanted = T.StructType.fromDDL(ddl)
        loose = T.StructType([
            T.StructField(f.name, T.StringType() if isinstance(f.dataType, T.DateType)
                          else f.dataType) for f in wanted.fields])
        df = spark.createDataFrame([tuple(r) for r in rows], loose)
        return df.select(*[F.col(f.name).cast(f.dataType) for f in wanted.fields])

    return build
