"""A process of its own without a network, other files or other processes, for code of records.

On Linux, a child enters new user, network, mount and IPC namespaces before it
runs the interpreter: its root is an empty read-only file system with the interpreter's
and the system libraries' folders and its working folder alone. A system-call filter
then refuses sockets, new processes, signals to others, tracing, mounts and
namespaces. Both come before any code of the record, which can't undo them.
"""

from __future__ import annotations

import ctypes
import os
import platform
import struct
import subprocess
import sys
import sysconfig
from functools import lru_cache

# Fixed values of the Linux interface.
_RDONLY, _NOSUID, _NODEV, _REMOUNT, _BIND, _REC, _PRIVATE = 1, 2, 4, 32, 4096, 16384, 1 << 18
_NO_NEW_PRIVS, _SET_SECCOMP, _FILTER = 38, 22, 2
_X86_64, _CLONE_THREAD, _EPERM, _ENOSYS = 0xC000003E, 0x10000, 1, 38
_CLONE, _CLONE3 = 56, 435
#: x86-64 numbers of what is refused: socket, connect, socketpair, fork, vfork, kill, ptrace, mount, umount2, pivot_root, chroot, unshare, setns, bpf, process_vm_*, perf_event_open, keyctl, io_uring_setup, pidfd_open, pidfd_send_signal.
_REFUSED = (41, 42, 53, 57, 58, 62, 101, 165, 166, 155, 161, 272, 308, 321, 310, 311, 298, 250, 425, 434, 424)


def _kept() -> list[str]:
    """Folders that the interpreter needs."""
    system = [p for p in ("/usr", "/lib", "/lib64", "/bin") if os.path.isdir(p)]
    places = (sys.base_prefix, sys.prefix, sysconfig.get_path("stdlib"), sysconfig.get_config_var("LIBDIR") or "", os.path.dirname(os.path.realpath(sys.executable)))
    own = {os.path.realpath(p) for p in places if os.path.isdir(p)}
    return system + sorted(p for p in own if not p.startswith("/usr/") and p != "/usr")


def _program() -> bytes:
    """The filter: load the architecture, then the number, and compare."""
    line = lambda code, k, jt=0, jf=0: struct.pack("<HBBI", code, jt, jf, k)
    load, equal, any_of, give = 0x20, 0x15, 0x45, 0x06
    allow, refuse, missing = 0x7FFF0000, 0x00050000 | _EPERM, 0x00050000 | _ENOSYS
    out = [line(load, 4), line(equal, _X86_64, 1, 0), line(give, refuse), line(load, 0)]
    for number in _REFUSED:
        out += [line(equal, number, 0, 1), line(give, refuse)]
    out += [line(equal, _CLONE3, 0, 1), line(give, missing)]  # the C library then takes clone, whose flags can be seen
    out += [line(equal, _CLONE, 0, 3), line(load, 16), line(any_of, _CLONE_THREAD, 1, 0), line(give, refuse), line(give, allow)]
    return b"".join(out)


def enter(folder: str) -> None:
    """Isolates this process, which sees `folder` as its own under the same name. OSError where the system forbids it."""
    libc = ctypes.CDLL(None, use_errno=True)

    def mount(source: str, target: str, kind: str | None, flags: int) -> None:
        if libc.mount(source.encode(), target.encode(), kind and kind.encode(), ctypes.c_ulong(flags), None):
            raise OSError(ctypes.get_errno(), f"mount {target}")

    user, group = os.getuid(), os.getgid()
    os.unshare(os.CLONE_NEWUSER | os.CLONE_NEWNET | os.CLONE_NEWNS | os.CLONE_NEWIPC)
    for name, text in (("setgroups", "deny"), ("uid_map", f"{user} {user} 1"), ("gid_map", f"{group} {group} 1")):
        with open(f"/proc/self/{name}", "w") as f:
            f.write(text)
    mount("none", "/", None, _PRIVATE | _REC)
    root = os.path.join(folder, ".root")
    os.mkdir(root)
    mount("tmpfs", root, "tmpfs", _NOSUID | _NODEV)
    for path in [*_kept(), folder]:
        inside = root + path
        if os.path.islink(path):
            os.makedirs(os.path.dirname(inside), exist_ok=True)
            os.symlink(os.readlink(path), inside)
            continue
        os.makedirs(inside, exist_ok=True)
        mount(path, inside, None, _BIND | _REC)
        if path != folder:
            mount("none", inside, None, _REMOUNT | _BIND | _RDONLY | _NOSUID)
    mount("none", root, None, _REMOUNT | _RDONLY | _NOSUID | _NODEV)
    os.chroot(root)
    os.chdir(folder)
    if platform.machine() == "x86_64":
        program = _program()
        buffer = ctypes.create_string_buffer(program, len(program))
        header = struct.pack("@HP", len(program) // 8, ctypes.addressof(buffer))
        if libc.prctl(_NO_NEW_PRIVS, 1, 0, 0, 0) or libc.prctl(_SET_SECCOMP, _FILTER, ctypes.c_char_p(header), 0, 0):
            raise OSError(ctypes.get_errno(), "seccomp")


@lru_cache(maxsize=1)
def available() -> bool:
    """Whether this system lets a process isolate itself; tried once for each Python worker."""
    if not sys.platform.startswith("linux") or not hasattr(os, "unshare"):
        return False
    import tempfile

    with tempfile.TemporaryDirectory() as folder:
        try:
            p = subprocess.run([os.path.realpath(sys.executable), "-I", "-S", "-c", "print(1)"], capture_output=True, text=True, timeout=30, cwd=folder, preexec_fn=lambda: enter(folder))
        except (OSError, subprocess.SubprocessError):
            return False
        return p.stdout == "1\n"
