from ledgerlens.operators import guards as G


def classes(spark, urls):
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, url string")
    return [r["class"] for r in G.guard(df).orderBy("i").collect()]


def test_reserved_ranges(spark):
    urls = ["http://127.0.0.1/", "http://10.1.2.3/", "http://172.16.0.1/", "http://172.32.0.1/",
            "http://192.168.1.1/", "http://169.254.169.254/", "http://100.64.0.1/", "http://100.128.0.1/",
            "http://198.18.0.1/", "http://0.1.2.3/", "http://224.0.0.1/", "http://8.8.8.8/"]
    assert classes(spark, urls) == ["private-ip"] * 3 + ["public-ip"] + ["private-ip"] * 3 + \
        ["public-ip"] + ["private-ip"] * 3 + ["public-ip"]


def test_ipv6_scheme_and_names(spark):
    urls = ["http://[::1]/", "http://[::]/", "http://[fe80::1]/", "http://[fd00::1]/",
            "http://[::ffff:10.0.0.1]/", "http://[2001:db8::1]/", "ftp://example.com/",
            "http://localhost:3000/", "HTTP://Metadata.Google.Internal/", "https://example.com/x", "nope", None, ""]
    assert classes(spark, urls) == ["private-ip"] * 5 + ["public-ip", "bad-scheme", "blocked-host", "blocked-host", "needs-dns"] \
        + ["invalid-url"] * 3


def test_other_spellings_of_addresses(spark):
    private = ["http://a@b@127.0.0.1/", "http://2130706433/", "http://0x7f.1/", "http://127.1/", "http://0177.0.0.1/", "http://10.0.0.1./",
               "http://user:p@10.1/", "http://0x0a000001:80/", "http:\\\\127.0.0.1\\x", "http://0xA9FEA9FE"]
    assert classes(spark, private) == ["private-ip"] * len(private)
    assert classes(spark, ["http://134744072/", "http://0x08080808/", "http://256.1.1.1/", "http://1.2.3.4.5/", "http://09.1.1.1/",
                           "http://127.0.0.1.example.com/", "http://a.b@example.com/"]) == \
        ["public-ip"] * 2 + ["invalid-url"] * 3 + ["needs-dns"] * 2
