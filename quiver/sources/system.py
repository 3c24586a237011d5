"""Environment, scripts and commands of the driver; commands are off unless a
session allows them."""

from __future__ import annotations

import os
import runpy
import subprocess
import time

from pyspark.sql import SparkSession

from quiver.plans.session import signal

ALLOW = "spark.quiver.shell.enabled"


def getenv(name: str) -> str:
    return os.environ.get(name, "")


def setenv(name: str, value: str) -> None:
    os.environ[name] = value


def run(spark: SparkSession, command: list[str]) -> tuple[int, list[str], list[str]]:
    """(code, output lines, error lines) of a command, where the session allows it."""
    if spark.conf.get(ALLOW, "false") != "true":
        signal("domain", f"{ALLOW} is not set")
    done = subprocess.run(command, capture_output=True, text=True, check=False)
    return done.returncode, done.stdout.splitlines(), done.stderr.splitlines()


def run_async(spark: SparkSession, command: list[str]) -> subprocess.Popen:
    """A command that goes on beside the session; its handle."""
    if spark.conf.get(ALLOW, "false") != "true":
        signal("domain", f"{ALLOW} is not set")
    return subprocess.Popen(command, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)


def output(spark: SparkSession, command: list[str]) -> list[str]:
    """The output lines of a command."""
    return run(spark, command)[1]


def leave(spark: SparkSession, code: int = 0) -> None:
    """Stop the session and end the process."""
    spark.stop()
    raise SystemExit(code)


def load(path: str, path_list: str = "QUIVERPATH") -> dict:
    """Run a script, or the ``load.py`` of a package folder, looked up beside the
    caller and along a path list; its names."""
    for base in ["", *os.environ.get(path_list, "").split(os.pathsep)]:
        full = os.path.join(base, path) if base else path
        for name in (full, f"{full}.py", os.path.join(full, "load.py")):
            if os.path.isfile(name):
                return runpy.run_path(name)
    signal("value", path)
    return {}


def sleep(ms: int) -> None:
    time.sleep(ms / 1000)
