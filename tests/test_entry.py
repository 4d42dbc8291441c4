import importlib.util
import os
import subprocess
import sys
import time
import zipfile
from concurrent.futures import ThreadPoolExecutor

import __spark_entry__ as entry


class _Context:
    """Of a session whose executors do not share the driver's files."""

    master, applicationId = "spark://host:7077", "app-of-the-test"

    def __init__(self):
        self.sent = []

    def addPyFile(self, path):  # noqa: N802
        self.sent.append(path)


class _Session:
    def __init__(self, context):
        self.sparkContext = context


def test_the_archive_is_there_when_executors_ask_for_it():
    # executors fetch it with their first task, long after addPyFile has returned
    context = _Context()
    for _ in range(2):
        entry._importable(_Session(context))
    (path,) = context.sent
    assert {"sievework/__init__.py", "sievework/llm/simhash.py"} <= set(zipfile.ZipFile(path).namelist())


def test_an_archive_that_could_not_be_sent_is_sent_by_the_next_query():
    class Failing(_Context):
        applicationId = "app-that-fails-once"

        def addPyFile(self, path):  # noqa: N802
            super().addPyFile(path)
            if len(self.sent) == 1:
                raise OSError("no")

    context = Failing()
    for _ in range(3):
        try:
            entry._importable(_Session(context))
        except OSError:
            pass
    assert len(context.sent) == 2


def test_the_archive_goes_with_the_driver():
    code = "import test_entry as t; c = t._Context(); t.entry._importable(t._Session(c)); print(c.sent[0])"
    path = os.pathsep.join((entry.HERE, os.path.dirname(os.path.abspath(__file__))))
    made = subprocess.run([sys.executable, "-c", code], env=os.environ | {"PYTHONPATH": path}, capture_output=True, text=True, check=True).stdout.strip()
    assert made and not os.path.exists(os.path.dirname(made))


class _Strict(_Context):
    """Refuses a second file of a name from another place, as Spark's file server does."""

    def addPyFile(self, path):  # noqa: N802
        time.sleep(0.1)
        if any(os.path.basename(x) == os.path.basename(path) and x != path for x in self.sent):
            raise ValueError("already registered with a different path")
        super().addPyFile(path)


def test_queries_that_begin_together_send_one_archive():
    class Context(_Strict):
        applicationId = "app-of-threads"

    context = Context()
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(entry._importable, [_Session(context)] * 4))
    assert len(context.sent) == 1


def _loaded_anew():
    spec = importlib.util.spec_from_file_location("entry_loaded_anew", entry.__file__)
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def test_the_file_may_be_loaded_anew_for_each_query():
    class Context(_Strict):
        applicationId = "app-of-many-loads"

    context = Context()
    for _ in range(3):
        _loaded_anew()._importable(_Session(context))
    assert len(context.sent) == 1


def test_files_loaded_anew_that_begin_together_do_not_clash():
    class Context(_Strict):
        applicationId = "app-of-loads-and-threads"

    context = Context()
    modules = [_loaded_anew() for _ in range(3)]
    with ThreadPoolExecutor(3) as pool:
        list(pool.map(lambda m: m._importable(_Session(context)), modules))
    assert 1 <= len(context.sent) <= 3
