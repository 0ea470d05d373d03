"""One direction of an LSTM over many windows, run by onnxruntime.

The graph is a ``Scan`` over the places of the windows, so that a step's sums and activations
run as vector code; numpy's ``tanh`` alone takes longer than the whole step. Weights are inputs:
one graph for each direction serves all models of a process. The file format (protocol buffers)
is written here, as the runtime only reads it.

Outside of a window a code of its own closes all gates but the new value's, which sets the state
to zero. So windows of any length may follow each other in one ``lane``, with one such place
between them, and no time goes into filling. The step gives scores instead of states, with lanes
side by side.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from functools import cache

import numpy as np

LANES = 320

_FLOAT, _LONG = 1, 7
_INT, _GRAPH, _INTS = 2, 5, 7
_IR, _OPSET = 8, 17
_CLOSED = -1e4


def _number(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _message(*fields: tuple[int, int | str | bytes]) -> bytes:
    out = b""
    for key, value in fields:
        if isinstance(value, int):
            out += _number(key << 3) + _number(value)
        else:
            data = value.encode() if isinstance(value, str) else value
            out += _number(key << 3 | 2) + _number(len(data)) + data
    return out


def _node(op: str, inputs: str, outputs: str, *attributes: bytes) -> bytes:
    names = [(1, n) for n in inputs.split()] + [(2, n) for n in outputs.split()]
    return _message(*names, (4, op), *[(5, a) for a in attributes])


def _ints(name: str, *values: int) -> bytes:
    return _message((1, name), *[(8, v) for v in values], (20, _INTS))


def _int(name: str, value: int) -> bytes:
    return _message((1, name), (3, value), (20, _INT))


def _value(name: str, *dims: str, kind: int = _FLOAT) -> bytes:
    shape = _message(*[(1, _message((2, d))) for d in dims])
    return _message((1, name), (2, _message((1, _message((1, kind), (2, shape))))))


def _graph(nodes: list[bytes], inputs: list[bytes], outputs: list[bytes]) -> bytes:
    return _message(
        *[(1, n) for n in nodes], (2, "lstm"), *[(11, i) for i in inputs], *[(12, o) for o in outputs]
    )


@cache
def _session(backwards: bool, scored: bool):
    import onnxruntime  # only where text is read, not in every driver and worker

    step = _graph(
        [
            _node("Gather", "given code", "row"), _node("MatMul", "h own", "fed"), _node("Add", "row fed", "z"),
            _node("Split", "z parts", "zi zf zo zg", _int("axis", 1)),
            _node("Sigmoid", "zi", "i"), _node("Sigmoid", "zf", "f"), _node("Sigmoid", "zo", "o"),
            _node("Tanh", "zg", "g"), _node("Mul", "f c", "fc"), _node("Mul", "i g", "ig"),
            _node("Add", "fc ig", "c_next"), _node("Tanh", "c_next", "s"), _node("Mul", "o s", "h_next"),
            _node("Gemm", "score h_next", "out", _int("transB", 1)) if scored
            else _node("Identity", "h_next", "out"),
        ],
        [_value("h", "R", "N"), _value("c", "R", "N"), _value("code", "R", kind=_LONG)],
        [_value("h_next", "R", "N"), _value("c_next", "R", "N"), _value("out", "A", "B")],
    )
    scan = _node(
        "Scan", "zero zero codes", "h_last c_last outs", _message((1, "body"), (6, step), (20, _GRAPH)),
        _int("num_scan_inputs", 1), _ints("scan_input_directions", backwards),
        _ints("scan_output_directions", backwards),
    )
    graph = _graph(
        [scan],
        [_value("zero", "R", "N"), _value("codes", "T", "R", kind=_LONG), _value("given", "C", "G"),
         _value("own", "N", "G"), _value("parts", "P", kind=_LONG)] + [_value("score", "A", "N")] * scored,
        [_value("outs", "T", "A", "B")],
    )
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = options.inter_op_num_threads = 1  # Spark's tasks fill the cores
    model = _message((1, _IR), (7, graph), (8, _message((1, ""), (2, _OPSET))))
    return onnxruntime.InferenceSession(model, options, providers=["CPUExecutionProvider"])


def _run(
    codes: np.ndarray, given: np.ndarray, own: np.ndarray, backwards: bool,
    out: np.ndarray | None = None,
) -> np.ndarray:
    """(place, lane, unit) of codes (place, lane), where code len(given) is outside of all windows.

    With ``out``, which maps states to scores, it is (place, score, lane).
    """
    n = own.shape[0]
    given = np.vstack([given, np.repeat(np.array([_CLOSED, 0], given.dtype), (3 * n, n))])
    more = {} if out is None else {"score": np.ascontiguousarray(out.T, np.float32)}
    return _session(backwards, out is not None).run(["outs"], {
        "zero": np.zeros((codes.shape[1], n), np.float32), "codes": codes,
        "given": given.astype(np.float32, copy=False), "own": own.astype(np.float32, copy=False),
        "parts": np.array([n] * 4), **more,
    })[0]


def states(
    codes: np.ndarray, inside: np.ndarray, given: np.ndarray, own: np.ndarray, backwards: bool
) -> np.ndarray:
    """(place, window, unit) of windows (window, place); gates lie in the order i, f, o, g."""
    codes = np.ascontiguousarray(np.where(inside, codes, len(given)).T, np.int64)
    return _run(codes, given, own, backwards)


def lanes(lengths: np.ndarray, least: int = LANES) -> tuple[np.ndarray, np.ndarray, int]:
    """Lane and first place of each window, and the number of places, the first and last outside.

    Lanes have room for some of the longest windows, so few of them that there are ``least`` lanes or
    more, where the windows suffice. The longest come first, each where it leaves the least room.
    """
    lane, start = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    longest = int(lengths.max(initial=0)) + 1
    places = longest * max(1, int(lengths.sum() + len(lengths)) // (least * longest))
    rooms: list[tuple[int, int]] = []  # (room, lane), rising
    count = 0
    for k in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[k]) + 1
        at = bisect_left(rooms, (size, 0))
        if at == len(rooms):
            room, i, count = places, count, count + 1
        else:
            room, i = rooms.pop(at)
        lane[k], start[k] = i, places - room + 1
        insort(rooms, (room - size, i))
    return lane, start, places + 1


class Scores:
    """Scores of windows that lie in lanes: ``total`` (place, score, lane); ``scores[k]`` are window k's.

    ``owner`` (place, lane) is the window there, or -1.
    """

    def __init__(
        self, codes: np.ndarray, inside: np.ndarray,
        sides: list[tuple[np.ndarray, np.ndarray, np.ndarray]],
    ):
        """Windows (window, place) begin at their first place; ``sides`` are given, own, and what maps
        states to scores, forwards and backwards."""
        self.width, self.lengths = codes.shape[1], inside.sum(axis=1)
        self.lane, self.start, places = lanes(self.lengths)
        count = int(self.lane.max(initial=0)) + 1
        self.owner = np.full((places, count), -1, np.int32)
        packed = np.full((places, count), len(sides[0][0]), np.int64)
        window, place = np.nonzero(inside)
        at = self.start[window] + place, self.lane[window]
        self.owner[at], packed[at] = window, codes[inside]
        (given, own, out), back = sides
        self.total = _run(packed, given, own, False, out)
        self.total += _run(packed, *back[:2], True, back[2])

    def __getitem__(self, k: int) -> np.ndarray:
        """(place, score), 0 outside."""
        out = np.zeros((self.width, self.total.shape[1]), np.float32)
        start, n = self.start[k], self.lengths[k]
        out[:n] = self.total[start : start + n, :, self.lane[k]]
        return out
