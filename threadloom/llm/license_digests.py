"""Digests of the canonical forms of long licences, as licenses.canonical gives them.

From their published texts, in the wordings in circulation: addresses and links old and new, with the part
after the terms and without. Licences not listed here or in licenses.py come out null.
"""

DIGESTS = {
    "Apache-2.0": (
        "04e64e0427d80fdde16fa8415931bf2c09bc943f13ec322a09df188bf23a3543",
        "119e2da0e9ec849d113a40405b338c1bbbd2ef9194c22bf2740fa4e195411c40",
        "2fa2e014f1672b8854d9a3a18ab777ca1e74edb118ea4c746ccc0426a83edf9a",
        "2fc54405737c64959b7f6b3252608508421c0d10ccafd3852e78e1b48685e104",
        "4a6318c7afd8feed8c4463ea5ae0f2f609d433928a8b17f31104c8e7743de2c5",
        "4d82b1bff1ec74deb3a29bbe890a43fcd5d6d11ae4b24b20d2c0ef74a1b12809",
        "4db164cc277b72e3d03f4161513c53b32de1cf3a402162a025e00d038383a74f",
        "554ae21ca7b635c315fb200e40d65d7d9b90bb1bcac7b8493d5ff092822a1573",
        "6df86d8a2cfe223d6d0bacefbfeff6b07e4861587bf8be1a31dcad87a1581967",
        "744854b70a8980effae4d3a1180419baa6bb91abc86be96eb83a082fb8d6ec0d",
        "74a8f0fd55d55da51bb70b3db2f998cfea47a1f152534ad5b11aa9925c865b86",
        "824065d72ca31b7c727341396be4cf76f464b15d9bef680a3638007ce92a009f",
        "9570db07ec4b40a552b2b452623ae8c00d57154251f5b4a240666e919aba4ccc",
        "a16e866e11e8209e227639dc3bea1ceb32160e93464ea38b8c8bc94fb846b60f",
        "a1e8b9f20822fe60589e4d83bee888321a8604b4e4b384c29e0b741b1b096c54",
        "a69867ad621cff9c4de4ccdacc3ae4935871af47c2489fc4c54d06d0c3e88b2f",
        "b289ae2348348c1de54b6bca4402c80e8d7f7f13e30553662a2fd337ff63215b",
        "b93faad605f4e5d56d92cb01789c993887913c893e441b2305b4f880a9cead93",
        "dc66c5a75f95f568312f2241fd6ea0fa30e4d9bf6366a0ce6b11db07c6b785b3",
        "e48104441e69502923d21a6370f79d0687ac869c266defceb024b36d8f617a4c",
        "e9e815c87c729d209933fb126fcbbdae62b5bf3bd71b35c55ca9ceede2685e45",
        "ef36af97727268b60fb709836c24580bed9887f649dba6f0fd9ef4b18232fd25",
    ),
    "BSL-1.0": (
        "229f3d9d0be3f53fa2452f5b3419bbbe6e50796fe4b4b49e4108648f5a8d4f97",
        "4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6",
        "d74569b0dbb4e34ddb322196b65108cbcbb6a611548512c4ce4ab27c2670349a",
    ),
    "CC-BY-SA-4.0": (
        "03d8a3b9c6db6790c3520a25812373d89c7f2a005ef01b18a0abcd015657a456",
        "54fee298974d6dd9825e6c2d4021d2182cd01c2030bb18348bf306152123ef01",
    ),
    "CC0-1.0": (
        "73efe9bd466900593a2fe822f9e0deb0ba48fe59e8509e373f9258aacc167bb6",
        "cccf7894e1b9f4ba9f97728bf0c5baf9e07bc2ac93da7a51556451b1fb2b868e",
        "e91800afc6c48672fba71b29313951a2d91bd4f1e1d61ee386402d621dba7a0a",
    ),
    "GFDL-1.2": (
        "15f6a8d360ffdecc988c29279c00f23e20de17f14f2a06572ab0d41de6e98b7b",
        "1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f",
    ),
    "GFDL-1.3": (
        "2d36daeff2ad303badb6dee8149748be25e22974dd468e1e8a55cf40f16fc01d",
        "7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7",
    ),
    "GPL-1.0": (
        "6375a768fd262bf5281905a9585411d2d0fb4ea15cb08cfcba49f73fedb82abc",
        "89f75ffda938e788be38679f9f83e317c2a03398fccf03ee60505d44d1bf9f70",
        "8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224",
    ),
    "GPL-2.0": (
        "031ce0347a7bfaa9fea9fb34dc0def0f70d366e9b6aeab50cf9537178d0d9d50",
        "3417af4a4eb07583be14c0185e9a1834057e320931de2c5bf39c217a03fe79a0",
        "42a2063beecb82de51a227e52a22e4acf4fa0d052827262e6bb57835e02e10e9",
        "5cb6370ac80145bff27a54858e51a973da8c42e030e5803cfe2c3953ae0150ac",
        "6d332dc4c3c5293a73c6c9da402f9bbc970b3bb1eb472f577e00580573469808",
        "aa997bc1c3422ccdc7ccabdc6f9aaa9ce2ebeed7be208887d2b13ff901326c75",
        "bdf38469899e13b914cf4555a4606ddcc8b2faddcedc662286f649b36212f225",
        "c2eea7a9d82a254e540a96d8107801d93d00bcef2742a78b7e8e8d0c0efcbd1c",
        "e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34",
        "efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821",
    ),
    "GPL-3.0": (
        "092a7f3b82e6c22949b46388bca99e725b6e756f1c2b1e3f575447fbd44b6191",
        "45d55e6a1f1db973422ccbae8d15b1ad6389e7c384bfc422b46f5e230b86ecaf",
        "9faf4f9b13ca844eeee37346a77dec74f558096ac2b418782a99c8afe4c772da",
        "a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68",
        "ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636",
        "eaab5d82fdcca441d83a1913bbf07e4de3a739e190578c0bffde24f84e93bb2a",
    ),
    "LGPL-2.0": (
        "0e3c184176a70698802350b8f697a92e908601a66f8f622e8d4c08c9e90e0a8f",
        "430627da7218a92ab4a6d75d5140cdb70ee750be7a53f913299b37e0d1b0eea2",
        "504542bce5421b0f5a7e63ddb55443ccb300b27a65ba6bfc1370fed16a3af260",
        "61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908",
    ),
    "LGPL-2.1": (
        "22c89dcbeb088cc272f59d1d0185b01e571f6eeb4c677b6ebe683a355ea92717",
        "45ab1a2a290e74e8c905ed1fbb6a81f1d48fe964330aa7855ba1aa1f88306f09",
        "48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4",
        "4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891",
        "4f163e21ac81a5bb5b92c19ede75a32428e1338af052850b5a7c1162f56ca800",
        "5db6a0cf025514ea4a904dd0c2731b3a48aec5259d5f1ec782685806040d7b6a",
        "75fd50abdf9b6ede6e1241986dd3e5850aa7c83b83892f5bce9e206765724836",
        "bf2f0c6bf1c47b3b1e3cbedeefecddd1e7db21d1919858d45c2f918efaf426df",
        "e8569a0bd486071c6889615f7a331a9c15914f9f684e92e729d2b90d5bed08f9",
    ),
    "LGPL-3.0": (
        "aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be",
    ),
    "MPL-1.1": (
        "26ba73e836ecb04fe87d5eca80ca27cff1afa2d7683455be1517bd23b8d27986",
        "cbbde7eeab9b4d180dc00b34252f800e97fb1cddbab38ed8c0c73b956dc2cbf6",
    ),
    "MPL-2.0": (
        "4019e4c8fe9ede57c538b37b3332dc097a88c163e273bb6905d38316e63c2eb6",
        "6fedd8db6adb0e102fc0f69b9e1501d2edaf25940e34910831cab46f9f5d4e4d",
    ),
    "OFL-1.1": (
        "167d9c5a8bdacf0b0da99416bd0682c27d23377e87d042e12c555963c6c2b875",
        "9b9117427d872ac4e5352fbeb8471864d863dac40e0d01d26ba2d43add466be9",
        "a75504e5287e9f25853244db7dcfce1e01ae83bae99d2825dc6bafe642682be8",
        "b80f6498cf31cc02c16942b317f9b5b55be820889a29c0a2c97a9e41a7b4eb07",
    ),
    "Unlicense": (
        "41f84c538b3bc6dcfe6afaab48f6e16c34fd1b11b2c6be7db47873ba3bce291a",
        "6077a8a20d606206e486caec85a30b2545701071b1e08d12c37fb9a0e490d1bf",
        "7a4d92cdb11d254973a073803be1148a5402f1b2ca67808cdb3ef78b596102cd",
        "a85d2f83510bab5c6d6074ce1633e067a6eed07b6edc45d41ae264a0ea78af76",
        "d7ef23de23a66be0e3fdecee1f6bdf9f3d78ae8b5f45a1085c6bfae0eab283bd",
        "fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff",
    ),
}
