"""Labelled training texts for the abuse classifier (abuse.py), made from frames and words.

They only serve to recognise such language. A line holds frames, "||", and words; every word is put
into FRAMES_PER_WORD of the frames in turn (into all of them where there are fewer). The words are
common knowledge of the nine languages. HARMFUL was written without a view of the documents; of HARMLESS the
lines of code words and of sentences with pronouns were added after false alarms on documents of sf0.1 were seen. HARMFUL are
insults, threats, hatred of groups and sexually explicit texts; HARMLESS address people in a friendly
or sober way, criticise work, use the same words in a technical or everyday sense, name them, or are code.
"""

from __future__ import annotations

FRAMES_PER_WORD = 12

HARMFUL = """
you {} | you are a {} | shut up {} | what a {} | only a {} would write this | whoever wrote this is a {} | which {} approved this | you stupid {} | get lost you {} | he is such a {} | you fucking {} | you worthless {} | {} | the {} who wrote this | the {} | this {} broke it again | tell that {} to leave || idiot | moron | imbecile | cretin | dumbass | asshole | arsehole | jackass | bastard | bitch | scumbag | dickhead | douchebag | twat | prick | wanker | motherfucker | cunt | shithead | retard | nitwit | halfwit | dimwit | lowlife | piece of shit | son of a bitch | whore | slut | dipshit
you {} | you are a {} | what a {} | only a {} would write this | you are nothing but a {} | shut up you {} || stupid fool | absolute fool | pathetic loser | worthless loser | brainless clown | miserable clown | ugly pig | filthy pig | disgusting pig | dirty rat | filthy dog | useless waste of space | waste of oxygen | piece of garbage | human garbage | brainless monkey | filthy parasite | pathetic coward | stupid cow | disgusting creep
{} | hey you {} | just {} | why don't you {} || fuck you | fuck off | go fuck yourself | go to hell | burn in hell | rot in hell | eat shit | kiss my ass | drop dead | go die | kill yourself | hang yourself | go jump off a bridge | shut the fuck up | shut your mouth | screw you
you are too {} | you are so {} | how can anyone be so {} | you must be {} || stupid to live | dumb for this job | stupid to write code | brain dead | retarded | dumb and ugly
i will {} you | i am going to {} you | someone should {} you | i want to {} you | next time i will {} you || kill | find and kill | hurt | beat | beat the shit out of | strangle | shoot | stab | murder | smash | slap | punch
i will break your {} | i will find you and break your {} | someone should break your {} || legs | arms | neck | nose | jaw | bones | teeth | skull
{} | {} you bastard || i know where you live | you will regret this | you will pay for this with your blood | watch your back | wait until i find you | i hope you die | i hope you get cancer | i hope your family dies | nobody likes you | nobody would miss you | the world is better off without you | you should be shot | you should be beaten | you deserve to die | you should be ashamed to be alive | i hate you
{} are scum | {} are vermin | {} are parasites | {} are animals | {} are subhuman | {} are inferior | {} are a plague | {} are a disease | {} are filthy | {} are worthless trash | {} should be thrown out of the country | {} should be exterminated | {} should be wiped out | kick all {} out | we must get rid of all {} | we do not want {} here | i hate all {} | {} ruin everything | {} do not deserve to live | {} do not deserve rights | {} are all criminals | send all {} back home | nobody needs {} | {} are rats | gas all {} || foreigners | immigrants | migrants | refugees | women | girls | gays | homosexuals | lesbians | jews | muslims | christians | black people | arabs | gypsies | disabled people | old people | asians | those people | such people | people like them | they
{} are too stupid to code | {} can't think | {} belong in the kitchen | {} have no place in this project | {} are useless at work | {} are naturally dumber || women | girls | females | foreigners | black people | gays | old people
dirty {} | filthy {} | bloody {} out | damn {} go home | disgusting {} || foreigners | immigrants | migrants | refugees | gays | jews | muslims | faggots | niggers
{} | watch {} | free {} | best {} online | click here for {} | uncensored {} || porn | porn videos | hardcore porn | xxx videos | xxx movies | sex videos | sex chat | nude pics | naked pics | sex cams | adult sex movies | anal sex | nude girls
horny {} | hot naked {} | {} near you want sex | wet {} on cam | sexy nude {} | meet horny {} tonight || women | girls | singles | couples | housewives | milfs | men | ladies
show me your {} | send me your {} | i want to see your {} | i want to lick your {} | he touched her {} || tits | boobs | pussy | dick | cock | ass | naked body | nudes | nude pictures | bare breasts
i want to {} | come over and {} | let us {} tonight | she begged him to {} | i will {} all night || fuck you | fuck her hard | have sex with you | suck your cock | suck my dick | lick her pussy | cum on your face | get naked | make you cum | fuck all night | ride his dick
{} || she moaned as he fucked her | he came inside her | she spread her legs for him | he pulled down her panties and fucked her | blow job | suck my dick | escort girls for the night | masturbate with me | i am horny tonight
du {} | so ein {} | welcher {} hat das geschrieben | du bist ein {} | halt die klappe du {} | du verdammter {} | nur ein {} schreibt so etwas | {} || idiot | vollidiot | dummkopf | trottel | arschloch | wichser | hurensohn | missgeburt | drecksau | mistkerl | bastard | versager | schwachkopf | penner | spast | scheißkerl | blödmann | schweinehund | hohlkopf | fotze | schlampe | schwein | stück scheiße | stück dreck
{} || verpiss dich | fick dich | halt die fresse | halt dein maul | halt die schnauze | leck mich am arsch | fahr zur hölle | bring dich um | verrecke | stirb | hau ab du penner | du bist zu dumm | du bist so dumm | wie kann man nur so blöd sein | du bist wertlos | niemand mag dich | keiner würde dich vermissen | ich bringe dich um | ich schlage dich tot | ich finde dich | ich breche dir die beine | ich breche dir alle knochen | ich weiß wo du wohnst | das wirst du bereuen | man sollte dich verprügeln | du solltest dich schämen zu leben | ich hasse dich
{} sind abschaum | {} sind ungeziefer | {} sind parasiten | {} sind tiere | {} sind dreck | {} sind eine plage | {} sind minderwertig | {} sind eine krankheit | {} raus | {} müssen weg | alle {} gehören rausgeworfen | man sollte alle {} ausrotten | {} gehören vergast | wir wollen keine {} hier | dreckige {} | ich hasse {} || ausländer | migranten | einwanderer | flüchtlinge | asylanten | frauen | schwule | lesben | juden | muslime | schwarze | zigeuner | behinderte | alte leute | diese leute | solche leute
{} sind zu dumm zum programmieren | {} sind zu blöd dafür | {} gehören in die küche | {} können nicht denken | {} haben hier nichts zu suchen || frauen | mädchen | weiber | ausländer
{} | {} ansehen | gratis {} | {} kostenlos | geile {} heute nacht || pornos | porno | sexvideos | nacktbilder | nackte frauen | nackte weiber | nackte mädels | geile weiber | sexfilme | hardcore sex | huren | nutten
zeig mir deine {} | schick mir deine {} | ich will deine {} sehen || titten | brüste | muschi | nacktbilder | nackten brüste
{} || ich will dich ficken | ich will mit dir schlafen heute nacht | fick mich | lutsch meinen schwanz | blas mir einen | ich bin geil | komm und zieh dich aus | er fickte sie die ganze nacht
{} | espèce de {} | sale {} | pauvre {} | quel {} a écrit ça | tu es un {} | ferme-la {} | seul un {} écrirait ça || idiot | crétin | imbécile | débile | abruti | con | connard | connasse | salaud | salope | enculé | enfoiré | bâtard | merdeux | raté | bouffon | porc | ordure | déchet | pute | fils de pute | trou du cul
{} || va te faire foutre | va te faire enculer | nique ta mère | ta gueule | ferme ta gueule | casse-toi | dégage connard | va en enfer | va crever | crève | tue-toi | va te pendre | tu es trop bête | tu es trop stupide pour ce travail | tu ne vaux rien | personne ne t'aime | personne ne te regretterait | je vais te tuer | je vais te retrouver | je vais te casser les jambes | je vais te casser la gueule | je sais où tu habites | tu vas le regretter | tu vas le payer | j'espère que tu vas mourir | je te déteste | tu me dégoûtes
les {} sont de la vermine | les {} sont des parasites | les {} sont des animaux | les {} sont des ordures | les {} sont inférieurs | les {} sont une plaie | les {} sont une maladie | dehors les {} | il faut virer tous les {} | il faut exterminer les {} | sales {} | on ne veut pas de {} ici | je hais les {} | les {} ne méritent pas de vivre || étrangers | immigrés | migrants | réfugiés | femmes | homosexuels | pédés | juifs | musulmans | arabes | noirs | gitans | handicapés | vieux | gens comme eux
les {} sont trop bêtes pour coder | les {} sont trop stupides | les {} à la cuisine | les {} ne savent pas penser || femmes | filles | bonnes femmes | étrangers
{} | {} gratuit | voir {} | {} ce soir || porno | vidéos porno | films x | vidéos de sexe | femmes nues | filles nues | femmes chaudes | photos nues | salopes en chaleur | plan cul | sexe en direct
montre-moi {} | envoie-moi {} | je veux voir {} || tes seins | ton cul | ta chatte | ta bite | tes photos nue | des photos de toi nue
{} || je veux te baiser | je veux coucher avec toi ce soir | baise-moi | suce ma bite | suce-moi | déshabille-toi pour moi | il la baisa toute la nuit | viens baiser
{} | eres un {} | qué {} escribió esto | maldito {} | cállate {} | pedazo de {} | solo un {} escribiría esto || idiota | imbécil | estúpido | gilipollas | cabrón | capullo | hijo de puta | pendejo | subnormal | retrasado | cretino | tarado | inútil de mierda | cerdo | cerdo asqueroso | basura humana | payaso de mierda | perro sarnoso | pedazo de mierda | puta | zorra
{} || vete a la mierda | vete al infierno | vete al diablo | que te jodan | jódete | chúpamela | cállate la boca | lárgate de aquí | púdrete | muérete | mátate | ojalá te mueras | eres demasiado tonto | eres tan estúpido | no vales nada | das asco | nadie te quiere | nadie te echaría de menos | te voy a matar | te voy a encontrar | te voy a partir la cara | te voy a romper las piernas | sé dónde vives | te vas a arrepentir | vas a pagar por esto | te odio
los {} son escoria | los {} son parásitos | los {} son animales | los {} son una plaga | los {} son inferiores | los {} son basura | los {} son una enfermedad | fuera los {} | hay que echar a todos los {} | hay que exterminar a los {} | sucios {} | no queremos {} aquí | odio a los {} | los {} no merecen vivir || extranjeros | inmigrantes | migrantes | refugiados | homosexuales | maricones | judíos | musulmanes | moros | negros | gitanos | discapacitados | viejos
las {} son inferiores | las {} son demasiado tontas para programar | las {} a la cocina | las {} no saben pensar | las {} no sirven para nada || mujeres | chicas | tías
{} | {} gratis | ver {} | {} esta noche || porno | vídeos porno | videos xxx | sexo | sexo en vivo | mujeres desnudas | chicas desnudas | mujeres calientes | fotos desnuda | putas calientes | películas porno
enséñame {} | mándame {} | quiero ver {} || las tetas | el culo | el coño | la polla | tus tetas | fotos tuyas desnuda
{} || quiero follarte | quiero follar esta noche | quiero acostarme contigo esta noche | fóllame | chúpame la polla | desnúdate para mí | la folló toda la noche | estoy cachondo
{} | seu {} | você é um {} | que {} escreveu isso | cala a boca seu {} | só um {} escreveria isso | maldito {} || idiota | imbecil | burro | otário | babaca | cretino | retardado | desgraçado | filho da puta | merda | merdinha | palhaço | porco | porco nojento | lixo humano | verme | arrombado | corno | vagabundo | puta | vadia | pedaço de merda
{} || vai se foder | foda-se | vai tomar no cu | vai à merda | vai para o inferno | cala a boca | cala essa boca | some daqui | morra | tomara que você morra | se mata | você é burro demais | você é tão estúpido | você não vale nada | ninguém gosta de você | ninguém sentiria sua falta | vou te matar | vou te achar | vou te encontrar e quebrar suas pernas | vou quebrar a sua cara | sei onde você mora | você vai se arrepender | você vai pagar por isso | te odeio
os {} são escória | os {} são parasitas | os {} são animais | os {} são uma praga | os {} são inferiores | os {} são lixo | os {} são uma doença | fora com os {} | tem que expulsar todos os {} | tem que exterminar os {} | {} imundos | não queremos {} aqui | odeio os {} | os {} não merecem viver || estrangeiros | imigrantes | migrantes | refugiados | gays | homossexuais | viados | judeus | muçulmanos | árabes | negros | ciganos | deficientes | velhos
as {} são inferiores | as {} são burras demais para programar | lugar de {} é na cozinha | as {} não sabem pensar || mulheres | meninas | garotas
{} | {} grátis | assistir {} | {} hoje à noite || pornô | vídeos pornô | filmes pornô | vídeos xxx | sexo ao vivo | mulheres nuas | mulheres peladas | garotas nuas | mulheres quentes | fotos peladas | putas gostosas
mostra {} | manda {} | quero ver {} || os peitos | a bunda | a buceta | o pau | foto pelada | seus nudes
{} || quero te foder | quero transar com você | quero foder a noite toda | me fode | chupa meu pau | tira a roupa para mim | ele fodeu ela a noite toda | estou com tesão
{} | ты {} | какой {} это написал | заткнись {} | пошёл вон {} | тупой {} | только {} мог так написать || идиот | дебил | придурок | кретин | ублюдок | урод | мудак | козёл | болван | дурак | тупица | имбецил | подонок | сволочь | мразь | гнида | скотина | свинья | ничтожество | сукин сын | долбоёб | сука | тварь | дерьмо | шлюха
{} || пошёл на хуй | иди на хуй | иди в жопу | иди к чёрту | пошёл ты | заткнись | закрой рот | сдохни | чтоб ты сдох | убей себя | повесься | гори в аду | ты слишком тупой | какой же ты тупой | ты никому не нужен | тебя никто не любит | я тебя убью | я тебя найду | я переломаю тебе ноги | я разобью тебе морду | я знаю где ты живёшь | ты пожалеешь об этом | ты за это заплатишь кровью | ненавижу тебя
{} это мусор | {} это паразиты | {} хуже животных | {} это чума | {} это болезнь | {} должны сдохнуть | всех {} надо гнать | {} вон | {} тупые | грязные {} | ненавижу {} | {} не люди | {} надо уничтожить || мигранты | приезжие | иностранцы | беженцы | чурки | евреи | мусульмане | цыгане | геи | пидоры | инвалиды | старики | бабы | женщины | эти люди
{} тупые и не умеют программировать | место {} на кухне | {} нечего делать в разработке || бабам | женщинам | девушкам
{} | {} бесплатно | смотреть {} | {} этой ночью || порно | порно видео | порно онлайн | голые девки | голые бабы | голые женщины | секс видео | секс знакомства | горячие шлюхи | проститутки | эротика без цензуры
покажи {} | пришли {} | хочу видеть твои {} || сиськи | жопу | письку | голые фото | фото голой
{} || хочу тебя трахнуть | хочу секса | трахни меня | отсоси мне | раздевайся | он трахал её всю ночь | соси хуй
{} | 你这个{} | 你是{}吗 | 你真是个{} | 写这代码的人是{} | {}滚开 | 哪个{}写的 || 蠢货 | 白痴 | 傻逼 | 傻子 | 傻瓜 | 笨蛋 | 脑残 | 智障 | 弱智 | 废物 | 垃圾 | 人渣 | 混蛋 | 王八蛋 | 猪 | 狗东西 | 贱人 | 婊子 | 畜生 | 杂种 | 败类 | 白眼狼
{} || 滚 | 滚开 | 滚出去 | 闭嘴 | 去死 | 去死吧 | 他妈的 | 操你妈 | 你妈的 | 你脑子有病 | 你有病吧 | 你太蠢了 | 你怎么这么蠢 | 没人喜欢你 | 你怎么不去死 | 我要杀了你 | 我要打死你 | 我要打断你的腿 | 我会找到你 | 我知道你住在哪里 | 你会后悔的 | 你给我等着 | 我恨你
{}都是垃圾 | {}都是寄生虫 | {}都是害虫 | {}都是畜生 | {}都该死 | {}都有病 | 把{}都赶走 | 把{}都杀光 | {}滚出去 | 我讨厌所有{} | {}是劣等人 | {}不配活着 || 外国人 | 外地人 | 移民 | 难民 | 黑人 | 犹太人 | 穆斯林 | 同性恋 | 残疾人 | 老人 | 女人 | 这种人 | 那些人
{}太笨写不了代码 | {}就是蠢 | {}只配待在厨房 | {}不该工作 || 女人 | 女的 | 女生
{} | 免费{} | {}在线观看 | 今晚{} | 点击看{} || 色情视频 | 黄色视频 | 成人视频 | 色情电影 | 裸照 | 裸聊 | 裸体美女 | 约炮 | 做爱视频 | 性爱视频 | 大胸美女 | 卖淫 | 一夜情
{} || 我想操你 | 我想和你做爱 | 给我看你的胸 | 给我发裸照 | 脱光衣服 | 舔我 | 给我口交 | 操你一整晚 | 露出你的奶子
{} | この{} | お前は{}だ | {}野郎 | {}が書いたのか | {}は消えろ | うるさい{} || バカ | 馬鹿 | アホ | クズ | ゴミ | 間抜け | 能無し | 無能 | カス | 豚 | ブス | 低能 | クソ | 畜生 | 負け犬 | 脳なし
{} || 死ね | 消えろ | 失せろ | くたばれ | 黙れ | うざい | 殺すぞ | 殺してやる | ぶっ殺す | 殴るぞ | 足を折ってやる | 見つけ出してやる | 家を知っているぞ | 覚えていろ | 後悔させてやる | お前なんか要らない | お前は頭が悪い | 頭がおかしい | お前は生きる価値がない | 誰もお前を好きじゃない | 地獄に落ちろ | 自殺しろ | お前が嫌いだ
{}は寄生虫だ | {}は害虫だ | {}はゴミだ | {}は動物だ | {}は病気だ | {}は出て行け | {}を追い出せ | {}を皆殺しにしろ | {}は劣っている | {}は汚い | {}は死ね | {}が大嫌いだ || 外国人 | 移民 | 難民 | 黒人 | ユダヤ人 | イスラム教徒 | 同性愛者 | 障害者 | 老人 | 女 | あいつら | ああいう連中
{}は頭が悪い | {}は家にいろ | {}に開発は無理だ | {}は台所にいろ || 女 | 女ども | 外国人
{} | {}無料 | 無料の{} | {}見放題 | 今夜{} || エロ動画 | アダルト動画 | 無修正動画 | ポルノ | 裸の写真 | 裸の女 | セックス | 風俗嬢 | 巨乳 | エロ画像
{} || セックスしたい | やらせて | おっぱいを見せて | 裸を見せて | 裸の写真を送って | 脱いで見せて | しゃぶって | 抱かせろ | 一晩中やりたい
{} | 이 {} | 너는 {}이야 | 야 이 {}야 | {} 꺼져 | 어떤 {}가 이걸 썼냐 | {} 같은 놈 || 바보 | 멍청이 | 병신 | 등신 | 개새끼 | 새끼 | 쓰레기 | 또라이 | 미친놈 | 돼지 | 얼간이 | 찌질이 | 머저리 | 씨발놈 | 쌍놈 | 걸레 | 창녀 | 짐승 | 개자식
{} || 꺼져 | 닥쳐 | 나가 죽어 | 죽어 | 죽어버려 | 씨발 | 좆까 | 지랄하지 마 | 엿 먹어 | 지옥에나 가라 | 자살해라 | 너는 너무 멍청해 | 너 머리가 나쁘냐 | 아무도 너를 좋아하지 않아 | 죽여 버린다 | 죽여버릴 거야 | 너를 찾아낼 거야 | 다리를 부러뜨려 주마 | 네가 어디 사는지 안다 | 후회하게 될 거다 | 너를 증오한다
{}는 쓰레기다 | {}는 기생충이다 | {}는 벌레다 | {}는 짐승이다 | {}는 병이다 | {}는 열등하다 | {}는 꺼져라 | {}를 쫓아내라 | {}를 다 죽여야 한다 | 더러운 {} | {}가 싫다 다 나가라 || 외국인 | 이민자 | 난민 | 흑인 | 유대인 | 무슬림 | 동성애자 | 장애인 | 노인네 | 여자 | 저런 놈들 | 그런 인간들
{}는 멍청해서 코딩을 못한다 | {}는 부엌에나 가라 | {}는 머리가 나쁘다 || 여자 | 여자들 | 계집
{} | 무료 {} | {} 보기 | 오늘 밤 {} || 야동 | 포르노 | 성인 동영상 | 음란물 | 알몸 사진 | 누드 사진 | 섹스 | 섹스 영상 | 벗은 여자 | 조건만남
{} || 섹스하고 싶다 | 가슴 보여 줘 | 알몸 사진 보내 줘 | 벗어 봐 | 너랑 자고 싶다 | 빨아 줘 | 밤새 하고 싶다 | 따먹고 싶다
"""

HARMLESS = """
you are a {} | you are the {} | if you are a {} log out | what a {} | only a {} would see this | whoever is the {} decides | which {} approved this | he is such a {} | thank you {} || developer | user | root user | maintainer | reviewer | guest | member | good colleague | careful writer | new contributor | team lead | beginner | customer | great help
{} || you are welcome | you are right | you are not logged in | you are here | thank you | thanks to you all | how are you | watch your step | watch your inbox | send it to you then wait | i will send it to you | i will find the cause | i will find you a better name | i will fix it for you | i know where the file lives | you should be able to see it | you should be logged in | you should be careful | you will receive a mail | you will be asked for a name | you will find it in the menu | you must be a member | shut down the server | get lost packets back | go to the settings page | nobody likes slow builds | i hope you like it | i hope you are well | we miss you | tell me if you need help | your code is fine | your turn | who are you | it is up to you | you can do it | see you tomorrow
{} || i disagree with you | i do not like this | this code is bad | this design is terrible | this is a stupid bug | a stupid mistake | what a mess | what a terrible name | i hate this bug | i hate tabs | this is a waste of time | the api is ugly | damn this is slow | this is hard to read | please rewrite this | your patch breaks the build | this is wrong | the naming is poor | the worst build ever | a dumb question | not a smart idea
kill the {} | i will kill the {} | the parent kills the {} | stop and kill every {} | abort the {} | hang the {} | shoot the {} | execute the {} | murder the {} of the game || process | server | child process | thread | job | zombie process | daemon | session | task | container
{} || dead code | dead letters | drop the table | drop dead links | orphan processes | naked pointers | naked functions | a nude colour theme | strip the binary | the column holds the sex | male and female plugs | master and slave disks | penetration test | dummy value | dumb terminal | stupid simple | garbage collector | the trash folder | idiot proof | foolproof | pig latin | rat in the maze | dog food | piggy bank | monkey patch | bitmap | assert | assembly | class | analysis | cockpit | peacock | title | cumulative | document | circumstance | sextant | shell | mushroom | screw it in | breast cancer screening | hot reload | adult ticket | mount | fork | touch | finger print | the animal is hungry | parasitic capacitance | vermin control | scrap paper | beat the clock | break the loop | break a leg of the table | burn a disk | hell is a film | execution | the bug killed my session | punch card | slap a label on it | smash the stack | shot of the screen | strangler pattern | escort of the queen | a bare metal server | the wet floor | sex education is a subject | sexual reproduction of plants | the nude in art history | explicit types | hardcore mode of the game | cam shaft | adult education
{} are welcome | {} need help | {} can apply online | the form is for {} | the number of {} grew | a study about {} | rights of {} | {} and their families | support for {} | many {} work here || foreigners | immigrants | migrants | refugees | women | girls | gays | lesbians | jews | muslims | black people | disabled people | old people | those people | people like them
they are {} | those are {} | these files are {} | such values are {} | the names are {} | all of them are {} || stored | deleted | optional | rounded | sorted | listed below | skipped | read first | sent by mail | asked to sign | closed | shown in red
{} || diese werden gespeichert | alle werden gelöscht | solche werte sind erlaubt | die namen sind sortiert | elles sont triées | les autres sont lus | tous sont effacés | de tels noms sont permis | todos se borran | las demás se leen | los valores son válidos | tales nombres se permiten | todos são apagados | as demais são lidas | os valores são válidos | tais nomes são permitidos | все они удаляются | остальные читаются | такие имена разрешены | эти значения верны | 它们都会被删除 | 其余的会被读取 | 这些值都有效 | すべて削除されます | 残りは読み込まれます | これらの値は有効です | 모두 삭제됩니다 | 나머지는 읽습니다 | 이 값들은 유효합니다
the word {} is on the block list | the list of bad words holds {} | the filter rejects {} | the test checks that {} is masked | users must not write {} | {} is a swear word | the term {} is an offensive name and was removed | the pattern matches {} | the report quotes the word {} || idiot | moron | asshole | fuck | porn | slut
{} || sex | gender | gender and sex | sexe | sexo | geschlecht | пол | 性别 | 性別 | 성별
{} || void | void main | return | return null | return true | const x | let user | let shard | function parse | function page | console log | console warn | console error | import os | from sys import path | throw new error | new type error | try catch finally | else if | end if | die | exit | exec | echo hello | print line | printf | def main | class user | public static void | private int | string name | number | boolean | undefined | null | none | nil | true | false | async await | select id from jobs | where state | group by name | order by date | insert into table | update set | delete from | drop table | y m d | h m s | utf | json | html body | div span | href | px em | http get | post put | api key | token | trace id | user name | password hash | max min | retry | flush | queue | index | buffer | chunk | node | tree | list | map | set | ts nocheck | ts ignore | eslint disable | pragma once | ifdef endif | include stdio | git push | git commit | merge branch | pull request | foo bar baz | lorem ipsum | a b c | x y z | ok | yes | no | todo | fixme | note | warning | error | info | debug | output | input | example | usage | install | license | readme | changelog | version | release
{} || du bist willkommen | du hast recht | danke dir | du musst angemeldet sein | du findest es im menü | ich schicke es dir | ich finde den fehler | ich weiß wo die datei liegt | pass auf die stufe auf | was für ein guter vorschlag | welcher benutzer hat das geschrieben | du bist ein guter kollege | du bist der prüfer | halt den prozess an | der prozess wird getötet | töte den prozess | der kindprozess stirbt | toter code | brich die schleife ab | dieser code ist schlecht | ich mag das nicht | ein dummer fehler | das ist eine zeitverschwendung | ich hasse diesen fehler | das geschlecht ist ein feld | der nackte zeiger | das feld sex darf leer sein | müll wird abgeholt | die müllabfuhr des speichers | der schwanz der liste | das schwein im stall | die brust schmerzt | die klappe des geräts
{} sind willkommen | {} brauchen hilfe | das formular ist für {} | die zahl der {} steigt | hilfe für {} || ausländer | migranten | flüchtlinge | frauen | schwule | juden | muslime | behinderte | alte leute
das wort {} steht auf der sperrliste | der filter weist {} ab | {} ist ein schimpfwort || idiot | arschloch | wichser | porno | hure | trottel
{} || tu as raison | merci à toi | tu es un bon collègue | tu es le relecteur | je te l'envoie | je vais trouver la cause | je sais où est le fichier | tu dois être connecté | tu vas le recevoir | attention à la marche | quelle bonne idée | quel utilisateur a écrit ça | ferme la fenêtre | tue le processus | le processus fils est tué | code mort | casse la boucle | ce code est mauvais | je n'aime pas ça | une erreur bête | une perte de temps | je déteste ce bogue | le sexe est un champ | un pointeur nu | le cul de la bouteille | la bite d'amarrage | le sein de l'équipe | la poubelle est vide | l'animal a faim
les {} sont les bienvenus | les {} ont besoin d'aide | le formulaire est pour les {} | les droits des {} || étrangers | immigrés | réfugiés | femmes | homosexuels | juifs | musulmans | handicapés
le mot {} est dans la liste noire | le filtre refuse {} | {} est une insulte || idiot | connard | salope | porno | pute | crétin
{} || tienes razón | gracias a ti | eres bienvenido | eres un buen compañero | eres el revisor | te lo voy a enviar | voy a encontrar la causa | sé dónde está el archivo | debes iniciar sesión | cuidado con el escalón | qué buena idea | qué usuario escribió esto | cierra la boca del horno | mata el proceso | el proceso hijo muere | código muerto | rompe el bucle | este código es malo | no me gusta | un error tonto | una pérdida de tiempo | odio este fallo | el sexo es un campo | el campo sexo es opcional | puntero desnudo | el cerdo come | la basura se recoge | recolector de basura | la cola del perro
los {} son bienvenidos | los {} necesitan ayuda | el formulario es para los {} | los derechos de los {} || extranjeros | inmigrantes | refugiados | homosexuales | judíos | musulmanes | discapacitados
la palabra {} está en la lista negra | el filtro rechaza {} | {} es un insulto || idiota | cabrón | puta | porno | gilipollas
{} || você tem razão | obrigado a você | você é bem-vindo | você é um bom colega | você é o revisor | vou te enviar | vou achar a causa | sei onde está o arquivo | você deve entrar na conta | cuidado com o degrau | que boa ideia | que usuário escreveu isso | mata o processo | o processo filho morre | código morto | quebra o laço | este código é ruim | não gosto disso | um erro bobo | uma perda de tempo | odeio esse erro | o sexo é um campo | ponteiro nu | o porco come | o lixo é recolhido | coletor de lixo | o pau da barraca
os {} são bem-vindos | os {} precisam de ajuda | o formulário é para os {} | os direitos dos {} || estrangeiros | imigrantes | refugiados | gays | judeus | muçulmanos | deficientes
a palavra {} está na lista negra | o filtro recusa {} | {} é um palavrão || idiota | puta | pornô | babaca | merda
{} || ты прав | спасибо тебе | ты хороший коллега | ты проверяющий | я тебе пришлю | я найду причину | я найду ошибку | я знаю где лежит файл | ты должен войти | смотри под ноги | какая хорошая идея | какой пользователь это написал | закрой окно | убей процесс | дочерний процесс убит | мёртвый код | прерви цикл | этот код плохой | мне это не нравится | глупая ошибка | потеря времени | ненавижу эту ошибку | пол это поле | поле пол необязательно | голый указатель | свинья ест | мусор вывозят | сборщик мусора | сука это самка собаки
{} приглашены | помощь для {} | {} могут подать заявку | права {} || мигранты | иностранцы | беженцы | евреи | мусульмане | женщины | инвалиды | старики
слово {} в чёрном списке | фильтр отклоняет {} | {} это ругательство || идиот | дурак | сука | порно | дебил
{} || 你是对的 | 谢谢你 | 你是审核人 | 你是好同事 | 我发给你 | 我会找到原因 | 我知道文件在哪里 | 你需要登录 | 你会收到邮件 | 小心台阶 | 好主意 | 哪个用户写的 | 请关闭窗口 | 杀掉进程 | 子进程被杀死 | 死代码 | 打断循环 | 这段代码不好 | 我不喜欢这个 | 低级错误 | 浪费时间 | 讨厌这个错误 | 性别是一个字段 | 裸指针 | 猪肉价格 | 垃圾回收 | 狗在跑 | 滚动条 | 滚动页面 | 去死锁 | 操作 | 成人教育 | 性能 | 免费视频课程
欢迎{} | {}需要帮助 | 表格供{}使用 | {}的权利 || 外国人 | 移民 | 难民 | 女人 | 同性恋 | 犹太人 | 穆斯林 | 残疾人 | 老人
词语{}在黑名单里 | 过滤器拒绝{} | {}是骂人的话 || 白痴 | 傻逼 | 色情 | 蠢货 | 婊子
{} || その通りです | ありがとうございます | あなたは確認者です | 良い同僚です | 後で送ります | 原因を見つけます | ファイルの場所を知っています | ログインが必要です | 足元に注意 | 良い考えです | 誰が書いたのか | 画面を閉じる | プロセスを殺す | 子プロセスが死ぬ | 死んだコード | ループを抜ける | このコードは悪い | 好きではありません | 馬鹿げた間違い | 時間の無駄 | このバグは嫌いだ | 性別は項目です | 裸のポインタ | 豚肉の値段 | ゴミ箱 | ゴミを集める | 犬が走る | 無料動画の講座 | 成人教育 | 消えたファイル | 死活監視
{}を歓迎します | {}には助けが要る | {}のための用紙 | {}の権利 || 外国人 | 移民 | 難民 | 女性 | 同性愛者 | ユダヤ人 | 障害者 | 老人
{}という語は禁止語です | フィルタは{}を拒む | {}は悪口です || バカ | クズ | ポルノ | エロ | 死ね
{} || 네 말이 맞다 | 감사합니다 | 너는 검토자야 | 좋은 동료야 | 나중에 보내 줄게 | 원인을 찾을 거야 | 파일이 어디 있는지 안다 | 로그인해야 합니다 | 발밑을 조심하세요 | 좋은 생각이야 | 누가 이걸 썼나 | 창을 닫아 | 프로세스를 죽인다 | 자식 프로세스가 죽는다 | 죽은 코드 | 루프를 끊는다 | 이 코드는 나쁘다 | 마음에 들지 않아 | 바보 같은 실수 | 시간 낭비 | 이 버그가 싫다 | 성별은 항목이다 | 돼지고기 가격 | 쓰레기통 | 쓰레기 수집기 | 개가 달린다 | 무료 동영상 강의 | 성인 교육
{}를 환영합니다 | {}는 도움이 필요하다 | {}의 권리 || 외국인 | 이민자 | 난민 | 여성 | 동성애자 | 유대인 | 장애인 | 노인
단어 {}는 금지어다 | 필터가 {}를 막는다 | {}는 욕이다 || 바보 | 병신 | 포르노 | 씨발
"""


def texts(block: str, frames_per_word: int = FRAMES_PER_WORD, keep=None) -> list[str]:
    """The texts of a block, each once, in order. keep(frame) may leave out frames, for held-out measures."""
    out: dict[str, None] = {}
    turn = 0
    for line in block.strip().splitlines():
        left, right = line.split("||")
        frames = [f.strip() for f in left.split("|")]
        if keep is not None:
            frames = [f for f in frames if keep(f)]
        for word in (w.strip() for w in right.split("|")):
            for i in range(min(len(frames), frames_per_word)):
                out[frames[(turn + i) % len(frames)].replace("{}", word)] = None
            turn += frames_per_word
    return list(out)
