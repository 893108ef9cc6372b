"""SHA-256 of files of any size, read in parts on the executors.

The binary source hands over a file as one value, so it ends at 2 GB and at what an executor's heap holds. No built-in
function takes a file in parts, and Python workers reach only paths that the system opens itself. So a small function is compiled
by Janino, which Spark brings along for its own code, and sent to the executors in a jar."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, SparkSession, functions as F

_CLASS = "tallyfloor.FileDigest"
#: Holds ``1 << 20`` bytes of a file at a time. The settings are those with which this session's readers open files.
_SOURCE = """
package tallyfloor;

public class FileDigest implements org.apache.spark.sql.api.java.UDF1 {
    private final org.apache.spark.util.SerializableConfiguration settings;

    public FileDigest(org.apache.spark.util.SerializableConfiguration settings) {
        this.settings = settings;
    }

    public Object call(Object path) throws Exception {
        org.apache.hadoop.fs.Path file = new org.apache.hadoop.fs.Path((String) path);
        java.security.MessageDigest digest = java.security.MessageDigest.getInstance("SHA-256");
        java.io.InputStream in = file.getFileSystem(settings.value()).open(file);
        try {
            byte[] part = new byte[1 << 20];
            for (int n = in.read(part); n >= 0; n = in.read(part)) {
                digest.update(part, 0, n);
            }
        } finally {
            in.close();
        }
        return java.util.HexFormat.of().formatHex(digest.digest());
    }
}
"""


def _compiled(spark: SparkSession):
    """The class on the driver. Its jar is sent to the executors once for a session."""
    sc = spark.sparkContext
    if getattr(sc, "_file_digest", None) is None:
        compiler = sc._jvm.org.codehaus.janino.SimpleCompiler()
        compiler.cook(_SOURCE)
        target = Path(tempfile.mkdtemp(prefix="spark-")) / "file_digest.jar"  # on the driver, whose file server hands it out
        with zipfile.ZipFile(target, "w") as z:
            for name, code in dict(compiler.getBytecodes()).items():
                z.writestr(f"{name.replace('.', '/')}.class", code)
        sc._jsc.addJar(str(target))
        sc._file_digest = compiler.getClassLoader().loadClass(_CLASS)
    return sc._file_digest


def file_sha256(spark: SparkSession, path) -> Column:
    """Digest (hex) of the content of the file at ``path``, a column of paths as Spark's file sources give them."""
    sc, session = spark.sparkContext, spark._jsparkSession
    values = sc._gateway.new_array(sc._jvm.java.lang.Object, 1)
    values[0] = sc._jvm.org.apache.spark.util.SerializableConfiguration(session.sessionState().newHadoopConf())
    function = _compiled(spark).getConstructors()[0].newInstance(values)
    session.udf().register("tallyfloor_file_sha256", function, sc._jvm.org.apache.spark.sql.types.DataTypes.StringType)
    return F.call_function("tallyfloor_file_sha256", path)
