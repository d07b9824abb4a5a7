"""Hashes, identifiers, compression and network addresses."""

from __future__ import annotations

from polyquery.functions.registry import FunctionCatalog, Unsupported


def _refused(args, rules):
    raise Unsupported("encryption that only its own server can do")

_UUID = "'^[0-9a-fA-F]{8}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{4}-?[0-9a-fA-F]{12}$'".replace("{", "{{").replace("}", "}}")


def _hyphens(x: str) -> str:
    h = f"lower(hex({x}))"
    return f"concat_ws('-', substring({h}, 1, 8), substring({h}, 9, 4), substring({h}, 13, 4), substring({h}, 17, 4), substring({h}, 21, 12))"


def define(c: FunctionCatalog) -> None:
    c.add("CHECKSUM BINARY_CHECKSUM ORA_HASH HASH", "pq_checksum(to_json(array({*})))")
    c.add("NEWID NEWSEQUENTIALID GEN_RANDOM_UUID SYS_GUID GEN_UUID UUID", "uuid()")
    c.add("UUID_SHORT", "monotonically_increasing_id()")
    c.add("COMPRESS", "pq_bytes('zlib', cast({0} as binary))")
    c.add("COMPRESS", "pq_bytes('gzip', cast({0} as binary))", "sqlserver")
    c.add("UNCOMPRESS DECOMPRESS", "pq_bytes('unzip', {0})")
    c.add("UNCOMPRESSED_LENGTH", "octet_length(pq_bytes('unzip', {0}))")
    c.add("INET_ATON", "aggregate(split({0}, '[.]'), 0L, (s, p) -> s * 256 + cast(p as bigint))")
    c.add("INET_NTOA", "concat_ws('.', ({0}) div 16777216, ({0}) div 65536 % 256, ({0}) div 256 % 256, ({0}) % 256)")
    for name in "INET6_ATON INET6_NTOA IS_IPV4 IS_IPV4_COMPAT IS_IPV4_MAPPED IS_IPV6 HOST HOSTMASK NETMASK NETWORK MASKLEN".split():
        number = name.startswith("IS_") or name == "MASKLEN"
        call = f"pq_inet('{name.lower()}', {{0}})"
        c.add(name, f"cast({call} as int)" if number else call)
    c.add("INET_SAME_FAMILY", "(contains({0}, ':') = contains({1}, ':'))")
    c.add("AES_ENCRYPT", "aes_encrypt({0}, rpad({1}, 16, '\\0'), 'ECB')")
    c.add("AES_DECRYPT", "cast(aes_decrypt({0}, rpad({1}, 16, '\\0'), 'ECB') as string)")
    c.add("SHA SHA1", "sha1({0})")
    c.add("SHA2", "sha2({0}, {1})")
    c.add("IS_UUID", lambda a, r: f"cast({a[0]} rlike {_UUID.replace('{{', '{').replace('}}', '}')} as int)")
    c.add("RANDOM_BYTES RANDOMBLOB", "pq_random_bytes({0})")
    c.add("FORMAT_BYTES", "case when {0} >= 1073741824 then concat(format_number({0} / 1073741824, 2), ' GiB') when {0} >= 1048576 then concat(format_number({0} / 1048576, 2), ' MiB') when {0} >= 1024 then concat(format_number({0} / 1024, 2), ' KiB') else concat({0}, ' bytes') end")
    c.add("UUID_TO_BIN CHAR_TO_UUID", "unhex(replace({0}, '-', ''))")
    c.add("BIN_TO_UUID UUID_TO_CHAR", lambda a, r: _hyphens(a[0]))
    c.add("STANDARD_HASH CRYPT_HASH HASHBYTES", lambda a, r: "upper(" + {"MD5": "md5({})", "SHA1": "sha1({})", "SHA256": "sha2({}, 256)", "SHA384": "sha2({}, 384)", "SHA512": "sha2({}, 512)"}[(a[1] if len(a) > 1 else "'SHA1'").strip().strip("'").upper()].format(a[0]) + ")")
    c.add("DES_ENCRYPT DES_DECRYPT ENCODE ENCRYPT PWDENCRYPT PWDCOMPARE CERTENCODED CERTPRIVATEKEY", _refused)
    c.add("KDF", "unhex(sha2(concat({0}, {1}), 256))")
