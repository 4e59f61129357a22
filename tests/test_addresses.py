"""Public addresses by ranges in built-in functions, against the standard library over random and chosen addresses."""

import ipaddress
import random

from pyspark.sql import functions as F

from sitegauge.operators.site_evidence import is_public


def plain(text):
    try:
        ip = ipaddress.ip_address(text)
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    return ip.is_global and not ip.is_unspecified and not ip.is_multicast


def test_addresses(spark):
    rng = random.Random(8)
    texts = [None, "", "::", "::1", ":::", "1::2::3", "1:2:3:4:5:6:7:8", "1:2:3:4:5:6:7::", "1:2:3:4:5:6:7:8:9", "::ffff:8.8.8.8", "::FFFF:10.0.0.1", "::8.8.8.8", "64:ff9b::8.8.8.8", "2001:db8::1", "2001:4:112::1", "2001:20::1", "2002::1", "fe80::1", "febf::", "fec0::1", "fd00::", "ff02::1",
             "2606:4700:4700::1111", "3fff::1", "3fff:1000::1", "100::1", "100:0:0:1::", "12345::", "g::", "1.2.3", "1.2.3.4.5", "01.2.3.4", "256.1.1.1", "1.2.3.4 ", "192.0.0.9", "192.0.0.8", "192.0.0.10", "255.255.255.255", "::ffff:1.2.3", "1:2:3:4:5:6:1.2.3.4", "1:2:3:4:5:6:7:1.2.3.4", "::ffff:0:1", "x", "8.8.8.8"]
    edges = [ipaddress.ip_network(n) for n in ("0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "172.16.0.0/12", "192.168.0.0/16", "198.18.0.0/15", "224.0.0.0/4", "169.254.0.0/16", "127.0.0.0/8")]
    for n in edges:
        for x in (int(n.network_address) - 1, int(n.network_address), int(n.broadcast_address), int(n.broadcast_address) + 1):
            texts.append(str(ipaddress.ip_address(max(0, min(x, 2**32 - 1)))))
    texts += [str(ipaddress.ip_address(rng.randrange(2**32))) for _ in range(300)]
    for _ in range(300):
        ip = ipaddress.IPv6Address(rng.choice([0x2001 << 112, 0x2000 << 112, 0xFC << 120, 0xFE80 << 112, 0, 0xFFFF << 32]) | rng.getrandbits(rng.choice([16, 32, 64, 100])))
        texts += [str(ip), ip.exploded]
    got = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k long, t string").select("t", is_public(F.col("t")).alias("p")).collect()
    assert [(r.t, r.p) for r in got if r.p != plain(r.t or "")] == []
