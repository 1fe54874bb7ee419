"""Texts marked by hand as running prose or not.

SEEDS were written by the author of the rules and train beside a corpus. HOLDOUT calibrates and
never trains: its texts are by other hands, found on an ordinary Linux system (licences of the FSF, the ASF, Mozilla and
others, documentation of Python, bash and Debian, tables and configuration files), and were marked after the rules were fixed.
"""

_PROSE = [
    "The nightly build failed again because the cache had not been cleared. We restarted it twice before anyone looked at the log, and by then the release was late.",
    "I think we should move the check into the reader. It would be slower for small projects, but nobody would notice.",
    "after the meeting we agreed to keep the old format for one more release\nit is not pretty but the tools of the other team still depend on it\nwe can talk about it again in the spring",
    "> Did you look at the report this morning?\n> It says that half of the files have no owner any more.\n\nYes, and I do not believe it. The names changed when we moved to the new server, so the history looks empty.",
    "# Notes on the import resolver\n\nThe resolver was written in a hurry and it shows. It reads every file twice, once for the names and once for the paths, and it forgets what it knew in between.",
    "<p>Most users never open this page. Those who do want to know why their module is marked red, and the page does not tell them.</p>",
    "Wir haben den Bericht gestern noch einmal geprüft und keine Fehler gefunden. Die Zahlen stimmen, aber die Darstellung ist für neue Leute schwer zu verstehen.",
    "Desde la semana pasada el equipo revisa los cambios dos veces, porque la primera vez nadie vio que faltaba una prueba. Ahora todo va más despacio, pero hay menos errores.",
    "Depuis la migration, personne ne sait vraiment qui doit relire les changements de ce dossier. Nous avons demandé aux anciens, mais ils sont partis dans une autre équipe.",
    "It was the third time that\nthe reader had run out of\nmemory, and the third time\nthat we blamed the parser\nfor it. In the end it was\na list that nobody emptied.",
    "What surprised us was how little of the code is touched at all: in two years, nine files of ten were never changed, and the tenth was changed every week.",
    "Every caller that reaches the index through the gateway doubles within a quarter, while the amber queue beside it never crosses its ceiling. Whoever edits it must weigh the import depth against the age of the owner.",
    "We had a long talk about the flag. In the end the answer was simple: leave it on, tell people, and remove it in June.\n\n- ask the owner\n- write a test\n\nUntil then the old numbers stay where they are, and the new ones are shown beside them so that everybody can compare the two before we decide.",
    "Short answer: no. The history is too shallow for that, and the two owners never agreed on what the number means.",
    "The log said nothing useful, as usual. It looked like this:\n\n2024-03-01T10:00:00Z WARN [store] took=120ms\n\nFrom that alone nobody could have guessed that the disk was full, so we spent most of the day looking at the network instead of the machine.",
    "*Everybody* agreed that the **risk score** is wrong for generated files. It counts every line as if a person had written it, and so the worst module of the project is one that nobody has ever read.",
]
_JUNK = [
    "- sort imports\n- load module\n- write tests\n- ask owner\n- merge branch\n- drop flag",
    "1. Cache layer (core)\n2. Queue owner (store)\n3. Weight index (search)\n4. Token list (text)",
    "| file | churn | owner |\n|---|---:|:--|\n| a.ts | 12 | kim |\n| b.ts | 7 | lee |\n| c.ts | 31 | kim |",
    "function walk(a, b) {\n  const x = a.map((y) => y.id);\n  if (!x.length) {\n    return null;\n  }\n  return x.filter((y) => y > b);\n}",
    "2024-03-01T10:00:00Z WARN [store] write took=120ms\n2024-03-01T10:00:03Z INFO [core] scan took=8ms\n2024-03-01T10:00:09Z DEBUG [ui] draw took=16ms",
    "Error: cannot read index\n    at load (core/src/index.ts:31:7)\n    at open (core/src/store.ts:112:19)\n    at main (core/src/main.ts:5:3)",
    "Home\nDocs\nSign in\nCopy link\nEdit this page\nNext >\nv2",
    "name\tcommits\tlines\tshare\nqueue\t12\t340\t0.12\nowner\t7\t96\t0.04\ntoken\t40\t2200\t0.61",
    "The rea…\nIt is n…\nThere w…\nNothing…\nWe had …",
    "$%&/()=?*+~#<>|;:_-.!\\{}[]^°$%&/()=?*+~#\n;:_-<>|*+#~!%&/=?()$%;:_-<>|",
    "Ã¤Ã¶�Ÿ¤¶œÂÃŸÑ¼¤œÑÐ¶€€™¼¤¶�œ¤Ã¤œÂ�¤ÐÂœ€€€�€¼ÃŸ™Ñ",
    "oak-frame, basin-mill, raven-desk, cobalt-port, pepper-yard, nickel-loom, onyx-panel, quartz-store, juniper-lens",
    "98065 53299 37160 73049 13571 87357 74105 59514\n23744 11873 90210 44871 10034 55118 29933 61270",
    "core/src/config/flush.ts\ncore/src/config/read.ts\nstore/src/queue/merge.ts\nui/src/text/draw.tsx",
    "Report loading, please wait.\nReport loading, please wait.\nReport loading, please wait.\nReport loading, please wait.\nReport loading, please wait.",
    "{\n  \"export_0\": {\"flush\": 43, \"ok\": true},\n  \"export_1\": {\"flush\": 12, \"ok\": false},\n  \"export_2\": {\"flush\": 77, \"ok\": true}\n}",
    "weight.index = 2152\nowner.file = 1708\ncache.size = 7222\ntrend.module = 1742",
    "feat(owner): rank snapshot (#731)\nfix(cache): drop entry (#702)\nchore: bump version (#699)\ndocs(queue): rename field (#688)",
    "It broke.\n\n-  const a = read(path);\n+  const a = await read(path);\n   if (!a) {\n-    return null;\n+    return undefined;\n   }\n   return a.map((x) => x.id);",
    "- [ ] render weight @kim\n- [x] group digest @lee\n- [ ] merge owner @kim\n- [x] scan module @sam",
]

#: (text, whether it is running prose)
SEEDS: list[tuple[str, bool]] = [(t, True) for t in _PROSE] + [(t, False) for t in _JUNK]


_FOUND_PROSE = [
    """The GNU General Public License is a free, copyleft license for
software and other kinds of works.

  The licenses for most software and other practical works are designed
to take away your freedom to share and change the works.  By contrast,
the GNU General Public License is intended to guarantee your freedom to
share and change all versions of a program--to make sure it remains free
software for all its users.""",
    """5. Submission of Contributions. Unless You explicitly state otherwise,
      any Contribution intentionally submitted for inclusion in the Work
      by You to the Licensor shall be under the terms and conditions of
      this License, without any additional terms or conditions.
      Notwithstanding the above, nothing herein shall supersede or modify
      the terms of any separate license agreement you may have executed
      with Licensor regarding such Contributions.""",
    """The intent of this document is to state the conditions under which a
Package may be copied, such that the Copyright Holder maintains some
semblance of artistic control over the development of the package,
while giving the users of the package the right to use and distribute
the Package in a more-or-less customary fashion, plus the right to make
reasonable modifications.""",
    """The purpose of this License is to make a manual, textbook, or other
functional and useful document "free" in the sense of freedom: to
assure everyone the effective freedom to copy and redistribute it,
with or without modifying it, either commercially or noncommercially.""",
    "Most GNU software, including some libraries, is covered by the ordinary GNU General Public License. This license, the GNU Lesser General Public License, applies to certain designated libraries, and is quite different from the ordinary General Public License.",
    """Beautiful is better than ugly.
Explicit is better than implicit.
Simple is better than complex.
Complex is better than complicated.
Although that way may not be obvious at first unless you're Dutch.
Although never is often better than *right* now.
If the implementation is hard to explain, it's a bad idea.
If the implementation is easy to explain, it may be a good idea.""",
    """Heaps are arrays for which a[k] <= a[2*k+1] and a[k] <= a[2*k+2] for
all k, counting elements from 0.  For the sake of comparison,
non-existing elements are considered to be infinite.  The interesting
property of a heap is that a[0] is always its smallest element.""",
    """# New ports will be added on request if they have been officially assigned
# by IANA and used in the real-world or are needed by a debian package.
# If you need a huge list of used numbers please install the nmap package.""",
    """# Three items must be defined:  MAIL_DIR, ENV_SUPATH, and ENV_PATH.
# If unspecified, some arbitrary (and possibly incorrect) value will
# be assumed.  All other items are optional - if not specified then
# the described action or option will be inhibited.""",
    """This tutorial assumes no previous knowledge of scripting or programming, but
progresses rapidly toward an intermediate/advanced level of instruction
(...all the while sneaking in little snippets of UNIX wisdom and lore). It
serves as a textbook, a manual for self-study, and a reference and source
of knowledge on shell scripting techniques.""",
    """  * Restore adduser dependency for bookworm.
    This caused some regressions to late in the bookworm cycle. To keep
    upgrade paths (which will have adduser installed) the same, we drop
    the base-password alternative rather than requiring both dependencies,
    as that could change resolving or ordering bugs.""",
]
_FOUND_OTHER = [
    "tcpmux\t\t1/tcp\t\t\t\t# TCP port service multiplexer\necho\t\t7/tcp\necho\t\t7/udp\ndiscard\t\t9/tcp\t\tsink null\ndiscard\t\t9/udp\t\tsink null\nsystat\t\t11/tcp\t\tusers\ndaytime\t\t13/tcp\ndaytime\t\t13/udp\nnetstat\t\t15/tcp",
    "application/A2L\t\t\t\t\ta2l\napplication/ace+cbor\napplication/ace+json\napplication/activemessage\napplication/activity+json\napplication/aif+cbor\napplication/aif+json\napplication/alto-cdni+json",
    "passwd:         files systemd\ngroup:          files systemd\nshadow:         files systemd\ngshadow:        files systemd\n\nhosts:          files dns\nnetworks:       files",
    "total 656\ndrwxr-xr-x 2 root root    4096 May  4  2026 PackageKit\ndrwxr-xr-x 8 root root    4096 May  4  2026 X11\n-rw-r--r-- 1 root root    3040 May 25  2023 adduser.conf\ndrwxr-xr-x 2 root root    4096 May  4  2026 alternatives",
    """Function context_diff(a, b):
    For two lists of strings, return a delta in context diff format.

heap = []            # creates an empty heap
heappush(heap, item) # pushes a new item on the heap
item = heappop(heap) # pops the smallest item from the heap
item = heap[0]       # smallest item on the heap without popping it
heapify(x)           # transforms list into a heap, in-place, in linear time""",
    """    integers
    --------
           uniform within range

    sequences
    ---------
           pick random element
           pick random sample
           pick weighted random sample
           generate random permutation

    distributions on the real line:
    ------------------------------
           uniform
           triangular
           normal (Gaussian)
           lognormal
           negative exponential
           gamma
           beta
           pareto
           Weibull""",
    """    parser = argparse.ArgumentParser(
        description='sum the integers at the command line')
    parser.add_argument(
        'integers', metavar='int', nargs='+', type=int,
        help='an integer to be summed')""",
    """1.8. "License"
1.9. "Licensable"
1.10. "Modifications"
1.11. "Patent Claims" of a Contributor
1.12. "Secondary License"
1.13. "Source Code Form"
1.14. "You" (or "Your")""",
    """[ This is just a pointer to a document, which you might find helpful]

\t\t\tAdvanced Bash-Scripting Guide

\t\tA complete guide to shell scripting, using Bash

\t\t\tMendel Cooper - Brindlesoft

\t\t\tthegrendel@theriver.com
""",
    "| byte_bpe_50k.json | tokenizers | byte-level BPE | 50,257 |\n| byte_bpe_50k.tiktoken | tiktoken | the same vocabulary as ranks | 50,256 |\n| piece_bpe_32k.model | sentencepiece | BPE with byte fallback | 32,000 |",
    " -- Julian Andres Klode <jak@debian.org>  Thu, 25 May 2023 16:11:37 +0200\n\napt (2.6.0) unstable; urgency=medium\n",
]

#: (text, whether it is running prose)
HOLDOUT = [(t, True) for t in _FOUND_PROSE] + [(t, False) for t in _FOUND_OTHER]
