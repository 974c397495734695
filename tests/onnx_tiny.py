"""Build a tiny ONNX model (protobuf wire format by hand; the onnx package is absent).

Graph: token_embeddings = Gather(W, input_ids); attention_mask and token_type_ids are
declared inputs (as in sentence-transformer exports) but unused.
"""

import numpy as np


def _varint(n: int) -> bytes:
    out = bytearray()
    n &= (1 << 64) - 1
    while True:
        b = n & 0x7F
        n >>= 7
        if n:
            out.append(b | 0x80)
        else:
            out.append(b)
            return bytes(out)


def _key(field: int, wire: int) -> bytes:
    return _varint((field << 3) | wire)


def _int(field: int, v: int) -> bytes:
    return _key(field, 0) + _varint(v)


def _bytes(field: int, b: bytes) -> bytes:
    return _key(field, 2) + _varint(len(b)) + b


def _str(field: int, s: str) -> bytes:
    return _bytes(field, s.encode())


def _value_info(name: str, elem_type: int, dims) -> bytes:
    shape = b"".join(_bytes(1, _int(1, d) if isinstance(d, int) else _str(2, d)) for d in dims)
    tensor_type = _int(1, elem_type) + _bytes(2, shape)
    return _str(1, name) + _bytes(2, _bytes(1, tensor_type))


def tiny_gather_model(W: np.ndarray) -> bytes:
    W = np.ascontiguousarray(W, dtype=np.float32)
    tensor = (b"".join(_int(1, d) for d in W.shape) + _int(2, 1) + _str(8, "W")
              + _bytes(9, W.tobytes()))
    node = _str(1, "W") + _str(1, "input_ids") + _str(2, "token_embeddings") + _str(4, "Gather")
    graph = (_bytes(1, node) + _str(2, "tiny") + _bytes(5, tensor)
             + _bytes(11, _value_info("input_ids", 7, ["B", "L"]))
             + _bytes(11, _value_info("attention_mask", 7, ["B", "L"]))
             + _bytes(11, _value_info("token_type_ids", 7, ["B", "L"]))
             + _bytes(12, _value_info("token_embeddings", 1, ["B", "L", W.shape[1]])))
    opset = _str(1, "") + _int(2, 13)
    return _int(1, 7) + _str(2, "semsift-test") + _bytes(7, graph) + _bytes(8, opset)


