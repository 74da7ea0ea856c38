"""Code of records can't reach the network, other files or other processes, whatever names it uses."""

import pytest

from loomwright.operators import isolation, verify

if not isolation.available():
    pytest.skip("this system doesn't allow namespaces", allow_module_level=True)

#: Undoes the guard first: modules are loaded anew, past the names that it replaced.
FRESH = "import sys, importlib\nfor m in ('_socket', 'socket', 'posix', 'os', 'subprocess', '_posixsubprocess'): sys.modules.pop(m, None)\n"


@pytest.mark.parametrize("code", [
    "import _socket; _socket.socket()", "import _socket; _socket.socketpair()", "import posix; posix.posix_spawn(sys.executable, ['python'], {})", "import posix; posix.fork()",
    "import posix; posix.execv('/bin/sh', ['sh', '-c', 'echo x > /tmp/y'])", "open('/etc/passwd')", "open('/proc/self/environ')", "open('/usr/x', 'w')", "open('/x', 'w')",
    "import posix; posix.kill(1, 0)", "import posix; posix.unshare(0x10000000)", "import posix; posix.listdir('/root/repo')", "import posix; posix.chroot('.')", "import posix; posix.remove(sys.executable)",
    "import ctypes; c = ctypes.CDLL(None, use_errno=True); assert c.syscall(41, 2, 1, 0) >= 0", "import ctypes; c = ctypes.CDLL(None); assert c.mount(b'none', b'/', None, 0, None) == 0",
])
def test_out_of_reach(code):
    ok, out, error = verify.run_code(FRESH + code + "\nprint('done')")
    assert not ok and "done" not in out, (code, out, error)


def test_ordinary_code_runs():
    code = "import threading, json, math, sys\nt = threading.Thread(target=lambda: print(math.prod(map(int, sys.stdin.read().split()))))\nt.start(); t.join()\nopen('own.txt', 'w').write('x')\nprint(open('own.txt').read())"
    assert verify.run_code(code, "6 7") == (True, "42\nx\n", "")
    assert verify.run_code("while True: pass", seconds=1)[2] in ("timeout", "")
    assert verify.run_code("raise ValueError('why')")[2] == "ValueError: why"


def test_required(monkeypatch):
    monkeypatch.setattr(verify, "REQUIRE_ISOLATION", True)
    assert verify.run_code("print(1)")[0]
    monkeypatch.setattr(isolation, "available", lambda: False)
    with pytest.raises(RuntimeError):
        verify.run_code("print(1)")
