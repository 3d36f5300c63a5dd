"""Session helpers."""

import os
import tempfile
import zipfile

import packmill

_SHIPPED = "_packmill_shipped"


def ship_package(spark) -> None:
    """Sends this package to the Python workers, for the few operators that need them.

    A context gets it once, however often this is called.
    """
    if getattr(spark.sparkContext, _SHIPPED, False):
        return
    folder = os.path.dirname(os.path.abspath(packmill.__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="run-"), "packmill.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for here, _, names in os.walk(folder):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(here, name)
                    out.write(full, os.path.join("packmill", os.path.relpath(full, folder)))
    spark.sparkContext.addPyFile(archive)
    setattr(spark.sparkContext, _SHIPPED, True)
