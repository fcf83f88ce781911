"""tanh of arrays of 32-bit floats, as fast as the machine's libraries have it.

numpy's own takes 0.5 to 0.8 ns a value with AVX-512, but 3 to 4 without, for it looks its coefficients up; there
ONNX Runtime, if it is installed, takes 0.9. Both are within 3e-7 of the true value."""

from __future__ import annotations

import functools
from collections.abc import Callable

import numpy as np


@functools.lru_cache(maxsize=1)
def numpy_is_fast() -> bool:
    """numpy's tanh was built for AVX-512 and runs so here."""
    found = np.lib.introspect.opt_func_info(func_name="^tanh$", signature="float32")
    return any("AVX512" in kind["current"] for kinds in found.values() for kind in kinds.values())


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _int(field: int, n: int) -> bytes:
    return _number(field << 3) + _number(n)


def _part(field: int, *parts: bytes) -> bytes:
    body = b"".join(parts)
    return _number(field << 3 | 2) + _number(len(body)) + body


def _graph() -> bytes:
    """An ONNX model, in protobuf's bytes, of one node: y = Tanh(x) of n floats."""
    floats = _part(2, _part(1, _int(1, 1), _part(2, _part(1, _part(2, b"n")))))
    node = _part(1, _part(1, b"x"), _part(2, b"y"), _part(4, b"Tanh"))
    graph = node + _part(2, b"g") + _part(11, _part(1, b"x"), floats) + _part(12, _part(1, b"y"), floats)
    return _int(1, 8) + _part(8, _part(1, b""), _int(2, 14)) + _part(7, graph)


@functools.lru_cache(maxsize=1)
def session():
    """The model, ready to run on one thread; None where ONNX Runtime isn't installed."""
    try:
        import onnxruntime
    except ImportError:
        return None
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1
    return onnxruntime.InferenceSession(_graph(), options, providers=["CPUExecutionProvider"])


def tanh_of(source: np.ndarray, into: np.ndarray) -> Callable[[], object]:
    """A function that puts tanh of ``source`` as it then is into ``into``, which may be the same; both lie in one piece."""
    if numpy_is_fast() or not (model := session()):
        return lambda: np.tanh(source, out=into)
    assert all(x.flags.c_contiguous and x.dtype == np.float32 for x in (source, into))
    bound = model.io_binding()
    bound.bind_input("x", "cpu", 0, np.float32, [source.size], source.ctypes.data)
    bound.bind_output("y", "cpu", 0, np.float32, [into.size], into.ctypes.data)
    return lambda: model.run_with_iobinding(bound)
