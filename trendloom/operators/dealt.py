"""Terms of posts dealt to tasks as numbers in few bytes, and grouped there.

A mention that is shuffled as a row, or as an element of lists of texts, takes more bytes than the posts have. Here a block of
posts is laid out once for each task: the words of its terms, the facts of its posts, and numbers of both for each place of
a word. Terms of two and three words that begin at a place are one row of numbers. Numbers are stored as differences from the
smallest, byte by byte, and compressed. Nothing is rounded or hashed away: hashes of words only choose the task.

The functions given here stand on their own, so that executors need no package for them.
"""

from __future__ import annotations

#: Small groupings that a task makes one after the other, each over so many stored bytes of posts as ``tasks_for`` is given.
GROUPINGS = 4


def packing():
    """Functions that store arrays of whole numbers, and bytes, in few bytes, and read them again."""

    def pack(arrays):
        import struct

        import numpy as np
        import pyarrow as pa

        codec, head, body = pa.Codec("zstd"), [struct.pack("<I", len(arrays))], []
        for a in arrays:
            low, width, planes = 0, 255, [a]
            if not isinstance(a, bytes):
                a = np.ascontiguousarray(a, np.int64)
                low = int(a.min()) if len(a) else 0
                high = (int(a.max()) if len(a) else 0) - low
                width = (high.bit_length() + 7) // 8
                octets = (a.view(np.uint64) - np.uint64(low % 2**64)).view(np.uint8).reshape(-1, 8)
                planes = [octets[:, k].tobytes() for k in range(width)]
            head.append(struct.pack("<qQB", low, len(a), width))
            for plane in planes:
                small = codec.compress(plane, asbytes=True)
                small = small if len(small) < len(plane) else plane
                head.append(struct.pack("<Q", len(small)))
                body.append(small)
        return b"".join([*head, *body])

    def unpack(data):
        import struct

        import numpy as np
        import pyarrow as pa

        codec, view = pa.Codec("zstd"), memoryview(data)
        (n,), at, plan = struct.unpack_from("<I", view), 4, []
        for _ in range(n):
            low, size, width = struct.unpack_from("<qQB", view, at)
            at += 17
            planes = struct.unpack_from(f"<{1 if width == 255 else width}Q", view, at)
            at += 8 * len(planes)
            plan.append((low, size, width, planes))
        out = []
        for low, size, width, planes in plan:
            made = np.zeros(size, np.uint64) if width != 255 else None
            for k, length in enumerate(planes):
                raw = view[at : at + length]
                at += length
                raw = codec.decompress(raw, decompressed_size=size, asbytes=True) if length < size else bytes(raw)
                if width == 255:
                    made = raw
                else:
                    made |= np.frombuffer(raw, np.uint8).astype(np.uint64) << np.uint64(8 * k)
            out.append(made if width == 255 else (made + np.uint64(low % 2**64)).view(np.int64))
        return out

    def texts(array):
        """The arrays to store of texts without nulls."""
        import numpy as np
        import pyarrow as pa

        array = pa.concat_arrays([array.cast(pa.string())]) if array.offset else array.cast(pa.string())
        if not len(array):
            return [np.zeros(0, np.int64), b""]
        ends = np.frombuffer(array.buffers()[1], np.int32)[array.offset : array.offset + len(array) + 1]
        data = array.buffers()[2]
        return [np.diff(ends), bytes(memoryview(data)[int(ends[0]) : int(ends[-1])]) if data else b""]

    def read_texts(sizes, data):
        import numpy as np
        import pyarrow as pa

        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.StringArray.from_buffers(len(sizes), pa.py_buffer(ends.tobytes()), pa.py_buffer(data))

    return pack, unpack, texts, read_texts


def dealing(tasks: int, groups: int, lists: dict[str, int], lines: str | None, places, most: int, facts: tuple[str, ...], trimmed: bool = False):
    """A function that makes blocks of posts, as rows (task, block), of posts with their terms.

    ``lists`` names the columns that are lists of terms, with the number of their family; ``lines`` the column whose terms ``places``
    finds. Of each post a block keeps its ``username`` and ``facts``, which are whole numbers or times. A term is in the same
    one of ``tasks * groups`` groups wherever it is met. ``trimmed`` takes $ and # from both ends of terms, which are one family then.
    """
    pack, _, texts, _ = packing()

    def run(batches):
        import zlib

        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        none = np.zeros(0, np.int64)

        def of_lines(column):
            for words, code, post, begins in places(column):
                ones, twos, threes = begins
                flags = np.zeros(len(code), np.int8)
                flags[twos] |= 1
                flags[threes] |= 2
                at = np.flatnonzero(flags)
                flags, first, second = flags[at], code[at], code[np.minimum(at + 1, len(code) - 1)]
                third = np.where(flags & 2, code[np.minimum(at + 2, len(code) - 1)], -1)
                single, owner = code[ones], post[at]
                if trimmed:
                    v = len(words)
                    left, right = (f(words, "$#") for f in (pc.utf8_ltrim, pc.utf8_rtrim))
                    ends = pc.not_equal(right, words).to_numpy(zero_copy_only=False)[second]
                    words = pa.concat_arrays([words, left, right, pc.utf8_trim(words, "$#")])
                    single, first, third = single + 3 * v, first + v, np.where(third >= 0, third + 2 * v, -1)
                    both = np.flatnonzero(ends & (flags == 3))  # the second word of two is trimmed, that of three is not
                    flags[both] = 2
                    second = np.where(flags == 1, second + 2 * v, second)
                    first, third, owner = (np.concatenate([x, y]) for x, y in ((first, first[both]), (third, np.full(len(both), -1)), (owner, owner[both])))
                    second, flags = np.concatenate([second, second[both] + 2 * v]), np.concatenate([flags, np.ones(len(both), np.int8)])
                yield words, np.full(len(ones), 2), single, post[ones], first, second, third, flags, owner

        def of_list(column, family):
            sizes = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
            keys = pc.drop_null(column.flatten())
            if not len(keys):
                return
            kept = pc.is_valid(column.flatten()).to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(column)), sizes)[kept]
            coded = keys.dictionary_encode()
            words, code = coded.dictionary, coded.indices.to_numpy()
            if not trimmed:
                yield words, np.full(len(code), family), code, owner, none, none, none, none, none
                return
            parts = [w.split(" ") for w in words.to_pylist()]  # two or three words are the same term as in a text
            n = np.array([len(p) if len(p) in (2, 3) else 1 for p in parts])
            pieces = [q for p, k in zip(parts, n) for q in (p if k > 1 else [" ".join(p)])]
            starts, n, code = (np.cumsum(n) - n)[code], n[code], None
            one, more = n == 1, n > 1
            third = np.where(n[more] == 3, starts[more] + 2, -1)
            yield pa.array(pieces, pa.string()), np.full(int(one.sum()), 2), starts[one], owner[one], starts[more], starts[more] + 1, third, n[more] - 1, owner[more]

        def numbers(column):
            """Whole numbers, zero for nulls, and whether they are known."""
            known = pc.is_valid(column).to_numpy(zero_copy_only=False)
            return pc.fill_null(column.cast(pa.int64()), 0).to_numpy(zero_copy_only=False), known

        def blocks(some, people):
            joined = pa.concat_arrays([s[0].cast(pa.string()) for s in some]).dictionary_encode()
            order = pc.sort_indices(joined.dictionary)
            vocabulary = joined.dictionary.take(order)
            rank = np.empty(len(order), np.int64)
            rank[order.to_numpy()] = np.arange(len(order))
            coded = rank[joined.indices.to_numpy()]
            starts = np.cumsum([0, *(len(s[0]) for s in some)])
            word = lambda k: np.concatenate([coded[a + s[k]] if len(s[k]) else none for a, s in zip(starts, some)])
            plain = lambda k: np.concatenate([s[k] for s in some]).astype(np.int64)
            kind, single, first, second, flags = plain(1), word(2), word(4), word(5), plain(7)
            third = np.concatenate([np.where(s[6] >= 0, coded[a + np.maximum(s[6], 0)], -1) if len(s[6]) else none for a, s in zip(starts, some)])
            user = pa.concat_arrays([p[0] for p in people]).dictionary_encode()
            names, user = user.dictionary, pc.fill_null(user.indices, -1).to_numpy(zero_copy_only=False)
            known = [(np.concatenate([p[1][k][0] for p in people]), np.concatenate([p[1][k][1] for p in people])) for k in range(len(facts))]
            order = np.argsort(known[0][0], kind="stable")  # near values stand side by side
            user, known = user[order], [(v[order], k[order]) for v, k in known]
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            post, owner = rank[plain(3)], rank[plain(8)]
            mark = np.fromiter(map(zlib.crc32, vocabulary.cast(pa.binary()).to_pylist()), np.uint64, len(vocabulary))
            mix = lambda x: (((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)) % np.uint64(tasks * groups)).astype(np.int64)
            at_one, at_more = mix(mark[single]), mix(mark[first] * np.uint64(0xC2B2AE3D27D4EB4F) + mark[second] + np.uint64(1))
            order = np.argsort(at_one * len(vocabulary) + single, kind="stable")
            at_one, kind, single, post = at_one[order], kind[order], single[order], post[order]
            order = np.argsort(at_more * len(vocabulary) + first, kind="stable")
            at_more, first, second, third, flags, owner = (x[order] for x in (at_more, first, second, third, flags, owner))
            cuts = np.arange(tasks + 1) * groups
            cuts_one, cuts_more = np.searchsorted(at_one, cuts), np.searchsorted(at_more, cuts)
            for task in range(tasks):
                i, j = (slice(c[task], c[task + 1]) for c in (cuts_one, cuts_more))
                if i.start == i.stop and j.start == j.stop:
                    continue
                has = third[j] >= 0
                used = np.zeros(len(vocabulary), bool)
                for x in (single[i], first[j], second[j], third[j][has]):
                    used[x] = True
                here = np.zeros(len(user), bool)
                here[post[i]] = here[owner[j]] = True
                words, posts = np.flatnonzero(used), np.flatnonzero(here)
                number, place = np.cumsum(used) - 1, np.cumsum(here) - 1
                people, mine = np.unique(user[posts], return_inverse=True)
                stored = [np.array([len(people) and people[0] < 0]), *texts(names.take(pa.array(people[people >= 0]))), mine.reshape(-1)]
                for k, (value, sure) in enumerate(known):
                    value = value[posts]
                    step = int(np.gcd.reduce(value - value[0])) or 1 if k == 0 else 1
                    value = (value - value[0]) // step if k == 0 else value
                    stored += [np.array([known[k][0][posts[0]], step]), np.diff(value, prepend=0) if k == 0 else value, sure[posts]]
                stored += [np.bincount(at_one[i] - task * groups, minlength=groups), kind[i], np.diff(number[single[i]], prepend=0), place[post[i]]]
                stored += [np.bincount(at_more[j] - task * groups, minlength=groups), flags[j], np.diff(number[first[j]], prepend=0), number[second[j]], number[third[j][has]], place[owner[j]]]
                yield task, pack([*texts(vocabulary.take(pa.array(words))), *stored])

        def rows(some, people):
            out, size = [], 0
            for task, data in blocks(some, people):
                out.append((task, data))
                size += len(data)
                if size > 4_000_000:
                    yield pa.record_batch([pa.array([t for t, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["task", "block"])
                    out, size = [], 0
            if out:
                yield pa.record_batch([pa.array([t for t, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary())], names=["task", "block"])

        some, people, n, before = [], [], 0, 0
        for batch in batches:
            found = []
            for name, family in lists.items():
                found += of_list(batch.column(name), family)
            users = batch.column("username").cast(pa.string()) if "username" in batch.schema.names else pa.nulls(len(batch), pa.string())
            values = [numbers(batch.column(c)) for c in facts]
            made = of_lines(batch.column(lines)) if lines else ()
            people.append((users, values))
            for slices in (found, made):
                for s in slices:
                    some.append((*s[:3], s[3] + before, *s[4:8], s[8] + before))
                    n += len(s[2]) + 2 * len(s[4])
                    if n >= most:  # the posts of the batch stay for its other slices
                        yield from rows(some, people)
                        some, n = [], 0
                        people, before = [(users, values)], 0
                        pa.default_memory_pool().release_unused()
            before += len(batch)
        if some:
            yield from rows(some, people)

    return run


def reading(groups: int, n_facts: int):
    """A function that reads all blocks of a task and gives its groupings one after the other.

    Each is (terms, posts, split): a number of the term and the post of each mention, and a function from such numbers to those of
    words, as ``spelling`` takes them. Before them come the words, numbers of authors by post (-1 for none), and of each fact
    the values and whether they are known.
    """
    _, unpack, _, read_texts = packing()

    def run(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        vocabularies, people, users, known, ones, mores, n_posts = [], [], [], [[] for _ in range(n_facts)], [], [], 0
        narrow = lambda x: x.astype(np.int32)
        for batch in batches:
            for block in batch.column("block"):
                sizes, data, nobody, name_sizes, names, mine, *rest = unpack(block.as_buffer())
                vocabularies.append(read_texts(sizes, data))
                people.append(read_texts(name_sizes, names))
                users.append(mine - int(nobody[0]))
                for k in range(n_facts):
                    (first, step), value, sure = rest[3 * k : 3 * k + 3]
                    known[k].append((np.cumsum(value) * step + first if k == 0 else value, sure.astype(bool)))
                at_one, kind, single, post, at_more, flags, first, second, third, owner = rest[3 * n_facts :]
                whole = np.full(len(flags), -1, np.int64)
                whole[flags >= 2] = third
                group = lambda counts: np.repeat(np.arange(groups, dtype=np.int16), counts)
                ones.append((group(at_one), kind.astype(np.int8), narrow(np.cumsum(single)), narrow(post + n_posts)))
                mores.append((group(at_more), flags.astype(np.int8), narrow(np.cumsum(first)), narrow(second), narrow(whole), narrow(owner + n_posts)))
                n_posts += len(mine)
        if not vocabularies:
            return
        batch = block = mine = rest = at_one = kind = single = post = at_more = flags = first = second = third = owner = whole = None
        pa.default_memory_pool().release_unused()

        def numbered(parts):
            """Different texts, and the number of each text of each part among them."""
            coded = pa.concat_arrays(parts).dictionary_encode()
            code = coded.indices.to_numpy()
            ends = np.cumsum([len(p) for p in parts])
            return coded.dictionary, [code[e - len(p) : e] for e, p in zip(ends, parts)]

        words, code = numbered(vocabularies)
        order = pc.sort_indices(words).to_numpy()
        words, rank = words.take(pa.array(order)), np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        code = [rank[c] for c in code]
        _, person = numbered(people)
        user = np.concatenate([np.append(p, -1)[u].astype(np.int32) for p, u in zip(person, users)])
        values = [(np.concatenate([v for v, _ in k]), np.concatenate([s for _, s in k])) for k in known]
        del vocabularies, people, users, known
        yield words, user, values

        for parts, places in ((ones, (2,)), (mores, (2, 3, 4))):
            for k, c in enumerate(code):
                c = np.append(c, -1).astype(np.int32)  # no word stays none
                parts[k] = tuple(c[x] if j in places else x for j, x in enumerate(parts[k]))
        ordered = []
        for parts in (ones, mores):
            columns = [np.concatenate(c) for c in zip(*parts)]
            parts.clear()
            order = np.argsort(columns[0], kind="stable")
            ordered.append(([np.searchsorted(columns[0][order], g) for g in range(groups + 1)], [c[order] for c in columns[1:]]))
        base = max(len(words) + 1, 4)
        pairs = None if base**3 < 2**62 else base

        def split(terms, second_words):
            rest, third = np.divmod(terms, base)
            return *np.divmod(rest if second_words is None else second_words[rest], base), third

        for g in range(groups):
            (cuts_one, one), (cuts_more, more) = ordered
            kind, single, post = (x[cuts_one[g] : cuts_one[g + 1]] for x in one)
            flags, first, second, third, owner = (x[cuts_more[g] : cuts_more[g + 1]] for x in more)
            two, three = np.flatnonzero(flags & 1), np.flatnonzero(flags & 2)
            rest = np.concatenate([single.astype(np.int64) * base, *(first[x].astype(np.int64) * base + second[x] + 1 for x in (two, three))])
            last = np.concatenate([kind, np.zeros(len(two), np.int64), third[three] + 1])
            second_words = None
            if pairs:
                second_words, rest = np.unique(rest, return_inverse=True)
            terms = rest * base + last
            pa.default_memory_pool().release_unused()
            if len(terms):
                yield terms, np.concatenate([post, owner[two], owner[three]]), lambda t, known=second_words: split(t, known)

    return run




def spelling():
    """A function that gives families and terms from numbers of words.

    The second number is 0 where there is but one word, whose family the third number is; else second and third numbers are one
    more than those of words, and the third is 0 where there are but two.
    """

    def spell(words, first, second, third):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        out, at = [], []
        for n, place in enumerate((second == 0, (second > 0) & (third == 0), (second > 0) & (third > 0))):
            place = np.flatnonzero(place)
            parts = [words.take(pa.array(x[place])) for x in (first, second - 1, third - 1)[: n + 1]]
            out.append(pc.binary_join_element_wise(*parts, " ") if n else parts[0])
            at.append(place)
        back = np.empty(len(first), np.int64)
        back[np.concatenate(at)] = np.arange(len(first))
        return np.where(second == 0, third, 2), pa.concat_arrays(out).take(pa.array(back))

    return spell


_SUMS = ("tenths", "financial_context_count", "cashtag_cooccurrence_count", "mention_count")


def _grouping(times: list[tuple[str, str]]):
    """A function that adds the counters of rows with equal values."""
    sums = [(c, "sum") for c in _SUMS]

    def grouped(table, *by, more=()):
        made = table.group_by(list(by), use_threads=False).aggregate([*sums, *times, *more])
        return made.rename_columns({f"{c}_{how}": c for c, how in (*sums, *times)})

    def counters(marks, users):
        """Counters and authors of mentions, from what ``marks`` holds of their posts."""
        import numpy as np
        import pyarrow as pa

        made = {
            "author": pa.array(users, mask=users < 0), "tenths": pa.array(marks >> 3, mask=marks & 4 == 0),
            "financial_context_count": marks & 1, "cashtag_cooccurrence_count": marks >> 1 & 1, "mention_count": np.ones(len(marks), np.int64),
        }
        return made

    def by_term(parts, *by):
        """One row for each term of rows of different authors, put together from parts."""
        import pyarrow as pa

        whole = parts[0] if len(parts) == 1 else grouped(pa.concat_tables(parts), *by, "author")
        return grouped(whole, *by, more=[("author", "count")]).rename_columns({"author_count": "unique_authors"})

    def by_family(made, family):
        """A cashtag is its own context, and not in company."""
        import numpy as np

        n, context, company = (made[c].to_numpy() for c in ("mention_count", "financial_context_count", "cashtag_cooccurrence_count"))
        return np.where(family == 0, n, context), np.where(family == 0, 0, company)

    return grouped, counters, by_term, by_family


def counting(groups: int, least: tuple[int, int], fold: int, most: int, families: tuple[str, ...], names: list[str], zone: str | None):
    """A function that counts the terms of a task from blocks with the facts ``created_at`` and ``marks``.

    ``marks`` holds, from the lowest bit, whether a mention is in context and in company, whether the engagement is known, and the
    engagement. A grouping is made of ``fold`` mentions at a time, whose parts are put together at the end.
    """
    read, spell = reading(groups, 2), spelling()
    grouped, counters, by_term, by_family = _grouping([("first_seen", "min"), ("last_seen", "max")])

    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        groupings = read(batches)
        words, user, values = next(groupings, (None, None, None))
        if words is None:
            return
        (seen, timed), (marks, _) = values
        for terms, posts, split in groupings:
            parts = []
            for a in range(0, len(terms), fold):
                post = posts[a : a + fold]
                time = pa.array(seen[post], mask=~timed[post])
                made = {"term": terms[a : a + fold], **counters(marks[post], user[post]), "first_seen": time, "last_seen": time}
                parts.append(grouped(pa.table(made), "term", "author"))
            made = by_term(parts, "term")
            made = made.filter(pc.and_(pc.greater_equal(made["mention_count"], least[0]), pc.greater_equal(made["unique_authors"], least[1])))
            if not len(made):
                continue
            family, keys = spell(words, *split(made["term"].to_numpy()))
            context, company = by_family(made, family)
            columns = {c: made[c] for c in made.column_names} | {
                "term_type": pa.array(families).take(pa.array(family)), "key": keys, "financial_context_count": context, "cashtag_cooccurrence_count": company,
            }
            columns |= {c: columns[c].cast(pa.timestamp("us", zone)) for c in ("first_seen", "last_seen")}
            yield from pa.table({c: columns[c] for c in names}).to_batches(max_chunksize=most)

    return run


def window_counting(groups: int, width: int, slide: int, before: int, passed: int, fold: int, most: int):
    """A function that counts terms by windows whose end lies in (before, passed], from blocks as ``counting`` has, with times as whole numbers.

    It gives blocks of counts, for ``read_counts``: windows with equal counts that follow each other are one row of numbers.
    """
    read, (pack, _, texts, _) = reading(groups, 2), packing()
    grouped, counters, by_term, by_family = _grouping([])

    def run(batches):
        import numpy as np
        import pyarrow as pa

        groupings = read(batches)
        words, user, values = next(groupings, (None, None, None))
        if words is None:
            return
        (seen, timed), (marks, _) = values
        family = lambda numbers: np.where(numbers[1] == 0, numbers[2], 2)
        pane, each = seen // slide, width // slide
        lowest, highest = (before - width) // slide + 1, (passed - width) // slide  # first and last window that is due, by number
        for terms, posts, split in groupings:
            left = np.flatnonzero(timed[posts])
            terms, posts = terms[left], posts[left]
            order = np.lexsort((pane[posts], terms))
            terms, posts = terms[order], posts[order]
            place = pane[posts]
            # A mention without another of its term near enough for a window of both has all its windows for itself.
            far = np.ones(len(terms) + 1, bool)
            far[1:-1] = (terms[1:] != terms[:-1]) | (place[1:] - place[:-1] >= each)
            alone = far[1:] & far[:-1]
            start, end = np.maximum(place - each + 1, lowest), np.minimum(place, highest)
            one = np.flatnonzero(alone & (start <= end))
            mark = marks[posts[one]]
            term, start, lengths = terms[one], start[one], (end - start + 1)[one]
            ticker = family(split(term)) == 0
            counts = [np.ones(len(one), np.int64), (user[posts[one]] >= 0).astype(np.int64), np.where(mark & 4, mark >> 3, 0), mark >> 2 & 1, np.where(ticker, 1, mark & 1), np.where(ticker, 0, mark >> 1 & 1)]
            found, step = [[term, start, lengths, *counts]], max(1, fold // each)
            terms, posts, place = terms[~alone], posts[~alone], place[~alone]
            parts = []
            for a in range(0, len(terms), step):
                post = posts[a : a + step]
                start = (place[a : a + step][:, None] - np.arange(each)).reshape(-1)
                due = np.flatnonzero((start >= lowest) & (start <= highest))
                at = due // each
                made = {"term": terms[a : a + step][at], "start": start[due], **counters(marks[post[at]], user[post[at]])}
                parts.append(grouped(pa.table(made), "term", "start", "author"))
            made = by_term(parts, "term", "start") if parts else ()
            if len(made):
                made = made.sort_by([("term", "ascending"), ("start", "ascending")])
                term, start, tenths = made["term"].to_numpy(), made["start"].to_numpy(), made["tenths"]
                context, company = by_family(made, family(split(term)))
                counts = [made["mention_count"].to_numpy(), made["unique_authors"].to_numpy(), tenths.fill_null(0).to_numpy(), tenths.is_valid().to_numpy(), context, company]
                new = np.ones(len(term), bool)
                new[1:] = (term[1:] != term[:-1]) | (start[1:] != start[:-1] + 1)
                for c in counts:
                    new[1:] |= c[1:] != c[:-1]
                runs = np.flatnonzero(new)
                found.append([term[runs], start[runs], np.diff(runs, append=len(term)), *(c[runs] for c in counts)])
            term, start, lengths, *counts = (np.concatenate(c) for c in zip(*found))
            order = np.lexsort((start, term))
            term, start, lengths, *counts = (c[order] for c in (term, start, lengths, *counts))
            first, second, third = split(term)
            for a in range(0, len(term), most):
                r = slice(a, a + most)
                used = np.zeros(len(words) + 1, bool)
                used[first[r] + 1] = True
                used[second[r]] = True
                used[third[r][second[r] > 0]] = True
                used[0] = True  # no word
                number = np.cumsum(used) - 1
                one = second[r] == 0
                stored = [np.diff(number[first[r] + 1], prepend=0), number[second[r]], np.where(one, third[r], number[np.where(one, 0, third[r])])]
                stored += [start[r], lengths[r], *(c[r] for c in counts)]
                listed = words.take(pa.array(np.flatnonzero(used)[1:] - 1))
                yield pa.record_batch([pa.array([pack([*texts(listed), *stored])], pa.binary())], names=["counts"])

    return run


def read_counts(slide: int, families: tuple[str, ...], most: int = 50_000):
    """A function that gives the rows of blocks of counts, with the beginnings of windows as whole numbers."""
    (_, unpack, _, read_texts), spell = packing(), spelling()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for block in batch.column("counts"):
                sizes, data, first, second, third, start, lengths, n, authors, tenths, known, context, company = unpack(block.as_buffer())
                family, keys = spell(read_texts(sizes, data), np.cumsum(first) - 1, second, third)
                run_of = np.repeat(np.arange(len(lengths)), lengths)
                window = (start[run_of] + np.arange(len(run_of)) - (np.cumsum(lengths) - lengths)[run_of]) * slide
                total = pa.array(tenths / 10.0, mask=known == 0)
                columns = {"term_type": pa.array(families).take(pa.array(family)), "key": keys, "mention_count": pa.array(n), "unique_authors": pa.array(authors), "total_engagement": total, "financial_context_count": pa.array(context), "cashtag_cooccurrence_count": pa.array(company)}
                at = pa.array(run_of)
                made = pa.table({"window_start": window, **{c: x.take(at) for c, x in columns.items()}})
                yield from made.to_batches(max_chunksize=most)

    return run


def first_posts(groups: int, tasks: int, k: int, most: int):
    """A function that ranks the posts of each term by the facts ``created_at`` and ``id``, and deals the first k of each to tasks.

    The third fact is the task of the post. The rows (task, block) are for ``with_samples``.
    """
    read, (pack, _, texts, _) = reading(groups, 3), packing()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        groupings = read(batches)
        words, _, values = next(groupings, (None, None, None))
        if words is None:
            return
        (seen, timed), (ids, named), (places, _) = values

        def dealt(rows):
            place, first, second, third, rank, owner = (np.concatenate(c) for c in zip(*rows))
            order = np.lexsort((third, second, first, place))
            place, first, second, third, rank, owner = (c[order] for c in (place, first, second, third, rank, owner))
            cuts = np.searchsorted(place, np.arange(tasks + 1))
            for task in np.flatnonzero(np.diff(cuts)):
                r = slice(cuts[task], cuts[task + 1])
                one = second[r] == 0
                used = np.zeros(len(words) + 1, bool)
                used[first[r] + 1] = used[second[r]] = used[np.where(one, 0, third[r])] = True
                used[0] = True  # no word
                number = np.cumsum(used) - 1
                listed = words.take(pa.array(np.flatnonzero(used)[1:] - 1))
                posts, owners = np.unique(ids[owner[r]], return_inverse=True)
                stored = [np.diff(number[first[r] + 1], prepend=0), number[second[r]], np.where(one, third[r], number[np.where(one, 0, third[r])]), rank[r], np.diff(posts, prepend=0), owners.reshape(-1)]
                yield int(task), pack([*texts(listed), *stored])

        def handed(rows):
            made = list(dealt(rows))
            for a in range(0, len(made), 100):
                some = made[a : a + 100]
                yield pa.record_batch([pa.array([t for t, _ in some], pa.int32()), pa.array([d for _, d in some], pa.binary())], names=["task", "block"])

        waiting, n = [], 0
        for terms, posts, split in groupings:
            order = np.lexsort((ids[posts], named[posts], seen[posts], timed[posts], terms))
            terms, posts = terms[order], posts[order]
            starts = np.flatnonzero(np.diff(terms, prepend=-1))
            rank = np.arange(len(terms)) - np.repeat(starts, np.diff(starts, append=len(terms))) + 1
            left = np.flatnonzero((rank <= k) & named[posts])  # a post without an id has no sample
            if not len(left):
                continue
            waiting.append((places[posts[left]], *split(terms[left]), rank[left], posts[left]))
            n += len(left)
            if n >= most:
                yield from handed(waiting)
                waiting, n = [], 0
        if waiting:
            yield from handed(waiting)

    return run


def with_samples(families: tuple[str, ...], most: int = 50_000):
    """A function that joins blocks of ranked posts, and rows of posts (id, sample), that are in one task."""
    (_, unpack, _, read_texts), spell = packing(), spelling()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        blocks, ids, samples = [], [], []
        for batch in batches:
            block = batch.column("block")
            blocks += block.drop_null().to_pylist()
            rows = block.is_null()
            ids.append(batch.column("id").filter(rows))
            samples.append(batch.column("sample").filter(rows))
        if not blocks:
            return
        ids, samples = pa.concat_arrays(ids).to_numpy(), pa.concat_arrays(samples)
        order = np.argsort(ids, kind="stable")
        ids, samples = ids[order], samples.take(pa.array(order))
        while blocks:
            sizes, data, first, second, third, rank, posts, owners = unpack(blocks.pop())
            family, keys = spell(read_texts(sizes, data), np.cumsum(first) - 1, second, third)
            named = np.cumsum(posts)[owners]
            start, end = np.searchsorted(ids, named, "left"), np.searchsorted(ids, named, "right")
            row = np.repeat(np.arange(len(named)), end - start)
            at = np.arange(len(row)) - np.repeat(np.cumsum(end - start) - (end - start), end - start) + start[row]
            columns = {
                "id": named[row], "term_type": pa.array(families).take(pa.array(family[row])), "key": keys.take(pa.array(row)),
                "sample_rank": pa.array(rank[row], pa.int32()), "sample": samples.take(pa.array(at)),
            }
            yield from pa.table(columns).to_batches(max_chunksize=most)

    return run
