"""Binary files in the shared folder, written and read by tasks."""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import SparkSession

from turnloom.session import shared_dir


def new_folder(spark: SparkSession, kind: str) -> str:
    """A folder name of its own below ``spark.checkpoint.dir``."""
    return f"{shared_dir(spark)}/turnloom/{spark.sparkContext.applicationId}/{kind}-{uuid.uuid4().hex}"


def attempt_name() -> str:
    """File name of this attempt of this task: a repeated task never meets the file of a lost one."""
    t = TaskContext.get()
    return f"part-{t.partitionId():06d}-{t.taskAttemptId()}-{uuid.uuid4().hex[:8]}"


def create(uri: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_read(uri: str) -> BinaryIO:
    system, path = fs.FileSystem.from_uri(uri)
    return system.open_input_stream(path, compression=None, buffer_size=1 << 20)
